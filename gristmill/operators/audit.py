"""The audit: all checks of a table as ranked findings, with the rows behind each; and the fixes safe to make unasked."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill import config
from gristmill.functions import scalars as S

from . import column_checks as C
from . import dataset_checks as D
from . import label_checks as L
from . import relation_checks as R
from .edits import Edit, again
from .tables import ROW, Table, is_missing, is_sentinel, present_number


@dataclass
class Finding:
    id: str
    check: str
    scope: str
    severity: str
    title: str
    column: str | None = None
    total: int = 0
    action: str = "review"
    evidence: dict = field(default_factory=dict)
    rows: DataFrame | None = None  # (_row_id); nothing is read until it is asked for


@dataclass
class Audit:
    table: Table
    findings: list[Finding]
    skipped: list[dict]
    cv_accuracy: float | None

    def issues(self) -> DataFrame:
        """One row a finding, ranked: severity, then rows affected, then the order of the checks."""
        schema = "place int, id string, check string, scope string, severity string, title string, column string, total_affected long, suggested_action string, evidence string"
        rows = [(k, f.id, f.check, f.scope, f.severity, f.title, f.column, f.total, f.action, json.dumps(f.evidence, default=str)) for k, f in enumerate(self.findings)]
        return self.table.df.sparkSession.createDataFrame(rows, schema)

    def issue_rows(self) -> DataFrame:
        """(issue_id, _row_id): every row of every finding, uncapped."""
        parts = [f.rows.select(F.lit(f.id).alias("issue_id"), ROW) for f in self.findings if f.rows is not None]
        empty = self.table.df.sparkSession.createDataFrame([], f"issue_id string, {ROW} long")
        return reduce(DataFrame.unionByName, parts, empty)

    def summary(self) -> dict:
        counts = {s: sum(f.severity == s for f in self.findings) for s in config.SEVERITIES}
        affected = self.issue_rows().select(ROW).distinct().count()
        return counts | {"rows_affected": affected, "cv_accuracy": self.cv_accuracy, "skipped_checks": self.skipped}

    def page(self, issue_id: str, number: int = 0, size: int = config.PAGE) -> DataFrame:
        """One page of the rows behind a finding."""
        found = next(f for f in self.findings if f.id == issue_id)
        return self.table.df.join(found.rows.distinct(), ROW, "left_semi").orderBy(ROW).offset(number * size).limit(size)


def rank(findings: list[Finding]) -> list[Finding]:
    return sorted(findings, key=lambda f: (config.SEVERITIES.index(f.severity), -f.total))


def _c(name: str):
    return F.col(f"`{name}`")


def _where(t: Table, condition) -> DataFrame:
    return t.df.where(condition).select(ROW)


def _rows_of(t: Table, col: str, values: list[str]) -> DataFrame:
    return _where(t, _c(col).isin(values))


def column_findings(t: Table, label, split, as_of) -> dict[str, Callable[[], list[Finding]]]:
    """Each check as a function of its own, so one can fail or be left out by itself."""
    forms = lambda col: [r["raw"] for r in C.sentinel_forms(t).where(F.col("col") == col).collect()]

    def c1():
        return [
            Finding(f"missing:{r['col']}", "C1_missingness", "column", r["severity"], f"{S.percent_text(r['missing_fraction'])} of rows missing in '{r['col']}'", r["col"], r["n_missing"], r["action"], {"missing_fraction": r["missing_fraction"], "fill_with": "Unknown"}, _where(t, is_missing(_c(r["col"]))))
            for r in C.missingness(t).collect()
        ]

    def sparse():
        rows = C.sparse_rows(t).select(ROW)
        n = rows.count()
        return [Finding("sparse_rows", "C1_sparse_rows", "row", "medium", f"{n} rows are more than half empty", None, n, "drop_rows", {}, rows)] if n else []

    def c2():
        return [Finding(f"constant:{r['col']}", "C2_constant", "column", "low", f"'{r['col']}' never varies", r["col"], r["n_rows"], "drop_column", {"top_value_share": r["top_share"]}) for r in C.constants(t).collect()]

    def c3():
        return [Finding(f"id_column:{r['col']}", "C3_id_like", "column", "medium", f"'{r['col']}' names rows", r["col"], r["n_unique"], "drop_column", {"n_unique": r["n_unique"]}) for r in C.id_like(t, label).collect()]

    def c4():
        return [Finding(f"mixed_types:{r['col']}", "C4_mixed_types", "column", "medium", f"'{r['col']}' mixes numbers and words", r["col"], r["n_offending"], "review", {"numeric_share": r["numeric_share"]}, _where(t, C.mixed_type_rows(_c(r["col"])))) for r in C.mixed_types(t).collect()]

    def c5():
        out, by = [], {}
        for r in C.variants(t).where("verdict <> 'canonical'").collect():
            by.setdefault(r["col"], []).append(r)
        for col, rs in by.items():
            told = {v: {} for v in ("safe", "contested")}
            for r in rs:
                told[r["verdict"]].setdefault(r["canonical"], []).append(r["raw"])
            safe = [x for xs in told["safe"].values() for x in xs]
            total = sum(r["n"] for r in rs if r["verdict"] == "safe")
            out.append(Finding(f"inconsistent:{col}", "C5_categorical_inconsistency", "column", "medium", f"'{col}' spells {len({r['norm'] for r in rs})} values in several ways", col, total, "normalize_values", {"canonical": told["safe"], "contested": told["contested"], "auto_apply": bool(safe)}, _rows_of(t, col, safe) if safe else None))
        return out

    def c6():
        by = {}
        for r in C.rare_values(t).collect():
            by.setdefault(r["col"], {})[r["raw"]] = r["n"]
        return [Finding(f"rare_categories:{c}", "C6_rare_categories", "column", "low", f"'{c}' has {len(v)} rare values", c, sum(v.values()), "review", {"rare": v}, _rows_of(t, c, list(v))) for c, v in by.items()]

    def c7():
        bounds = {r["col"]: r for r in C.fences(t).collect()}
        out = []
        for r in C.outliers(t).collect():
            b, x = bounds[r["col"]], present_number(_c(r["col"]))
            hit = F.lit(False)
            for lo, hi in (("low_iqr", "high_iqr"), ("low_mad", "high_mad")):
                if b[lo] is not None:
                    hit = hit | (x < b[lo]) | (x > b[hi])
            out.append(Finding(f"outliers:{r['col']}", "C7_outliers", "column", "medium", f"{r['n_outliers']} outliers in '{r['col']}'", r["col"], r["n_outliers"], "review", {"by_iqr": r["by_iqr"], "by_mad": r["by_mad"], "median": r["median"]}, _where(t, hit)))
        return out

    def c8():
        out = [Finding(f"future_dates:{r['col']}", "C8_implausible", "column", "medium", f"{r['n_future']} dates in '{r['col']}' lie ahead", r["col"], r["n_future"], "review", {}, _where(t, S.to_timestamp(_c(r["col"])) > F.lit(as_of).cast("timestamp_ntz"))) for r in C.future_dates(t, as_of).collect()] if as_of else []
        out += [Finding(f"unexpected_negative:{r['col']}", "C8_implausible", "column", "medium", f"{r['n_negative']} negative values in '{r['col']}'", r["col"], r["n_negative"], "review", {}, _where(t, present_number(_c(r["col"])) < 0)) for r in C.unexpected_negatives(t).collect()]
        out += [Finding(f"scale_break:{r['col']}", "C8_implausible", "column", "medium", f"'{r['col']}' has a value of another scale", r["col"], 1, "review", {}, _where(t, present_number(_c(r["col"])) == r["largest"])) for r in C.scale_breaks(t).collect()]
        return out

    def c9():
        both = [(r["a"], r["b"], r["r"], "pearson") for r in C.pearson(t, label).collect()] + [(r["a"], r["b"], r["v"], "cramers_v") for r in C.cramers_v(t, label).collect()]
        return [Finding(f"redundant:{a}|{b}", "C9_redundant", "column", "low", f"'{a}' and '{b}' carry the same information", a, t.n_rows, "drop_column", {"pair": [a, b], "correlation": x, "measure": m}) for a, b, x, m in both]

    def c11():
        return [Finding(f"sentinel:{r['col']}", "C11_sentinel_values", "column", "medium", f"'{r['col']}' has words for no value", r["col"], r["n_sentinel"], "blank_values", {"forms": forms(r["col"]), "count": r["n_sentinel"], "auto_apply": r["auto"]}, _where(t, is_sentinel(_c(r["col"])))) for r in C.sentinels(t).collect()]

    def spread(check, id, severity, action, title, plan, test):
        def run():
            told = {r["col"]: r["n_cells"] for r in plan(t).orderBy(F.desc("n_cells"), "col").collect()}
            if not told:
                return []
            rows = C.rows_where(t, test)
            return [Finding(id, check, "dataset", severity, f"{sum(told.values())} cells {title}", None, rows.count(), action, {"columns": dict(list(told.items())[:10])}, rows)]

        return run

    def c15():
        return [Finding(f"format_number:{r['col']}", "C15_formatted_numbers", "column", "medium", f"'{r['col']}' holds numbers in dress", r["col"], r["n_dressed"], "reformat_number", {"n_units": r["n_units"], "n_symbols": r["n_symbols"], "percent": r["percent"], "auto_apply": r["auto"]}, _where(t, ~is_missing(_c(r["col"])) & S.needs_reformatting(_c(r["col"])))) for r in C.formatted_numbers(t).collect()]

    def c16():
        return [Finding(f"format_date:{r['col']}", "C16_mixed_date_formats", "column", r["severity"], f"'{r['col']}' writes dates in {r['n_styles']} ways", r["col"], r["n_changing"], "reformat_date", {"dayfirst": r["dayfirst"], "auto_apply": r["auto"]}, _where(t, S.parse_date(_c(r["col"]), r["dayfirst"]) != S.strip(_c(r["col"])))) for r in C.date_formats(t).collect()]

    def c17():
        return [Finding(f"boolean:{r['col']}", "C17_inconsistent_booleans", "column", "medium", f"'{r['col']}' spells truth in {r['n_spellings']} ways", r["col"], r["n_parsed"], "normalize_boolean", {"distinct": r["n_spellings"]}, _where(t, S.parse_boolean(_c(r["col"])).isNotNull())) for r in C.booleans(t).collect()]

    def c18():
        return [Finding(f"out_of_band:{r['col']}", "C18_out_of_band_code", "column", "medium", f"{r['code']:g} in '{r['col']}' looks like a code", r["col"], r["n"], "blank_values", {"code": r["code"], "forms": [x["raw"] for x in t.values.where((F.col("col") == r["col"]) & (F.col("num") == r["code"])).select("raw").collect()]}, _where(t, present_number(_c(r["col"])) == r["code"])) for r in C.codes(t).collect()]

    def c19():
        by = {}
        for r in C.entities(t).collect():
            by.setdefault(r["col"], []).append(r)
        out = []
        for c, rs in by.items():
            other = [r for r in rs if r["raw"] != r["canonical"]]
            out.append(Finding(f"entity:{c}", "C19_entity_variants", "column", "medium", f"'{c}' names {len({r['key'] for r in rs})} things in several ways", c, sum(r["n"] for r in other), "normalize_values", {"canonical": {r["raw"]: r["canonical"] for r in other}, "auto_apply": False}, _rows_of(t, c, [r["raw"] for r in other])))
        return out

    def c21():
        return [Finding(f"markup:{r['col']}", "C21_markup", "column", "medium", f"{r['n_markup']} values in '{r['col']}' hold HTML", r["col"], r["n_markup"], "strip_markup", {}, _where(t, S.has_markup(_c(r["col"])))) for r in C.markup(t).collect()]

    return {
        "C1_missingness": c1, "C11_sentinel_values": c11, "C14_untrimmed": spread("C14_untrimmed", "untrimmed", "low", "trim", "have space around them", C.untrimmed, lambda v: v != S.strip(v)),
        "C20_invisible_characters": spread("C20_invisible_characters", "invisible", "medium", "strip_invisible", "hold characters that cannot be seen", C.invisible, S.has_invisible),
        "C1_sparse_rows": sparse, "C2_constant": c2, "C3_id_like": c3, "C4_mixed_types": c4, "C5_categorical_inconsistency": c5, "C19_entity_variants": c19, "C6_rare_categories": c6,
        "C7_outliers": c7, "C8_implausible": c8, "C9_redundant": c9, "C15_formatted_numbers": c15, "C16_mixed_date_formats": c16, "C17_inconsistent_booleans": c17, "C18_out_of_band_code": c18, "C21_markup": c21,
    }


def relation_findings(t: Table) -> dict[str, Callable[[], list[Finding]]]:
    clean = t.without_sentinels()

    def c12():
        out = []
        for r in R.dependencies(clean).collect():
            k, g = r["source"], r["target"]
            settled = R.lookup(clean.df, k, g).where(f"kinds = 1 and support >= {config.RULE_KEY_SUPPORT}").collect()  # at most RULE_KEYS_MOST keys
            out.append(Finding(f"dependency:{g}<-{k}", "C12_functional_dependency", "column", "medium", f"'{g}' can be looked up from '{k}'", g, r["fillable"], "fill_from_column", {"source": k, "mapping": {x["key"]: x["value"] for x in settled}, "support": r["support"], "decisive_keys": r["decisive_keys"], "total_keys": r["total_keys"]}, R.fill_values(clean, k, g).select(ROW)))
        return out

    def c13():
        out = []
        for r in R.arithmetic(clean).collect():
            text = f"{r['target']} = {r['a']} {SIGNS[r['operation']]} {r['b']}"
            gaps = []
            for col, op, x, y in R.rearranged(r["target"], r["operation"], r["a"], r["b"]):
                rows = R.computable(clean, col, op, x, y).select(ROW)
                if n := rows.count():
                    gaps.append(Finding(f"relation:{col}<-{op}({x},{y})", "C13_arithmetic_relation", "column", "medium", f"{n} gaps in '{col}' follow from {text}", col, n, "fill_from_formula", {"operation": op, "left": x, "right": y, "support": r["support"], "distinct_inputs": r["distinct_inputs"], "formula": text, "auto_apply": r["auto"]}, rows))
            out += gaps or [Finding(f"relation:{r['target']}", "C13_arithmetic_relation", "column", "low", f"{text} on every complete row", r["target"], 0, "review", {"formula": text, "support": r["support"]})]
        return out

    def c22():
        out = []
        for r in R.orderings(clean).collect():
            value = (lambda c: S.to_timestamp(_c(c))) if r["kind"] == "date" else (lambda c: present_number(_c(c)))
            out.append(Finding(f"ordering:{r['left']}:{r['right']}", "C22_ordering_violation", "dataset", "high" if r["kind"] == "date" else "medium", f"{r['n_broken']} rows have '{r['left']}' after '{r['right']}'", r["right"], r["n_broken"], "review", {"left": r["left"], "right": r["right"], "kind": r["kind"], "holds_share": r["share"], "support": r["support"]}, _where(clean, value(r["left"]) > value(r["right"]))))
        return out

    return {"C12_functional_dependency": c12, "C13_arithmetic_relation": c13, "C22_ordering_violation": c22}


def dataset_findings(t: Table, label, split, skipped: list[dict]) -> dict[str, Callable[[], list[Finding]]]:
    def d1():
        r = D.duplicate_summary(t).first()
        return [Finding("exact_duplicates", "D1_exact_duplicates", "dataset", "medium", f"{r['n_rows']} rows are copies of each other", None, r["n_rows"], "dedupe", {"n_groups": r["n_groups"], "n_redundant": r["n_redundant"], "auto_apply": r["auto"]}, D.duplicate_rows(t))] if r["n_groups"] else []

    def d2():
        pairs = D.near_duplicates(t, split)
        n = pairs.count()
        rows = pairs.select(F.col("a").alias(ROW)).unionByName(pairs.select(F.col("b").alias(ROW))).distinct()
        return [Finding("near_duplicates", "D2_near_duplicates", "dataset", "medium", f"{n} pairs of near copies", None, rows.count(), "dedupe", {"n_pairs": n, "pairs": [r.asDict() for r in pairs.orderBy("a", "b").limit(50).collect()]}, rows)] if n else []

    def d3():
        if not label or label not in t.columns:
            skipped.append({"check": "D3_class_imbalance", "reason": "no label column was chosen"})
            return []
        return [Finding(f"imbalance:{label}", "D3_class_imbalance", "dataset", r["severity"], f"the smallest class of '{label}' is {S.percent_text(r['share'])} of rows", label, r["n"], "review", {"counts": {x["label"]: x["n"] for x in D.class_sizes(t, label).collect()}}, _where(t, _c(label) == r["label"])) for r in D.class_imbalance(t, label).collect()]

    def d4():
        if not split or split not in t.columns:
            skipped.append({"check": "D4_train_test_overlap", "reason": "no split column was chosen"})
            return []
        if t.kinds[split]["n_raw"] < 2:
            skipped.append({"check": "D4_train_test_overlap", "reason": f"'{split}' has fewer than two values"})
            return []
        exact, near = D.exact_overlap(t, split), D.near_overlap(t, split)
        rows = exact.unionByName(near).distinct()
        n = rows.count()
        k = exact.count()
        return [Finding("train_test_overlap", "D4_train_test_overlap", "dataset", "high", f"{n} rows stand on both sides of '{split}'", split, n, "drop_rows", {"n_exact": k, "n_near_only": n - k}, rows)] if n else []

    def d5():
        return [Finding("summary_row", "D5_summary_row", "row", "medium", f"the last row sums up {r['n_matched']} columns", None, 1, "drop_rows", {"columns_matched": r["columns"], "columns_compared": r["n_compared"], "labelled": r["labelled"], "auto_apply": r["auto"]}, _where(t, F.col(ROW) == r[ROW])) for r in D.totals_row(t).collect()]

    return {"D1_exact_duplicates": d1, "D5_summary_row": d5, "D3_class_imbalance": d3, "D2_near_duplicates": d2, "D4_train_test_overlap": d4}


def audit(t: Table, label: str | None = None, split: str | None = None, checks: list[str] | None = None, as_of: str | None = None) -> Audit:
    """Run the checks asked for (all by default). A check that fails is named among the skipped; the others go on."""
    skipped: list[dict] = []
    accuracy: list[float] = []

    def c10():
        told, why = L.leakage(t, label, split)
        if why:
            skipped.append({"check": "C10_leakage", "reason": why})
        return [Finding(f"leakage:{r['col']}", "C10_leakage", "column", "high", f"'{r['col']}' alone predicts '{label}' at {r['accuracy']:.2f}", r["col"], t.n_rows, "drop_column", {"accuracy": r["accuracy"], "majority_baseline": r["majority"]}) for r in told.collect()]

    def r1():
        rows, about = L.mislabels(t, label, split)
        if "skipped" in about:
            skipped.append({"check": "R1_mislabels", "reason": about["skipped"]})
            return []
        accuracy.append(about["cv_accuracy"])
        rows = rows.cache()
        n = rows.count()
        top = [r.asDict() for r in rows.orderBy(F.desc("noise"), ROW).limit(200).collect()]
        severe = "high" if n / t.n_rows > config.WRONG_HIGH and not about["weak"] else "medium"
        return [Finding(f"mislabels:{label}", "R1_mislabels", "row", severe, f"{n} rows have a label the model disagrees with", label, n, "relabel", {"cv_accuracy": about["cv_accuracy"], "low_confidence": about["weak"], "share_of_rows": n / t.n_rows, "dropped_classes": about["dropped"], "rows": top}, rows.select(ROW))] if n else []

    every = dataset_findings(t, label, split, skipped) | {"C10_leakage": c10} | column_findings(t, label, split, as_of) | relation_findings(t) | {"R1_mislabels": r1}
    found: list[Finding] = []
    for name, run in every.items():
        if checks and name not in checks:
            continue
        try:
            found += run()
        except Exception as error:  # plans fail when they run, so each is caught here
            skipped.append({"check": name, "reason": f"failed to run - {type(error).__name__}: {str(error)[:200]}"})
    return Audit(t, rank(found), skipped, accuracy[0] if accuracy else None)


SIGNS = {"product": "x", "sum": "+", "difference": "-"}
# The order in which safe fixes are applied; computed fills go both before and after lookups.
ORDER = [
    "strip_invisible", "strip_markup", "trim", "blank_values", "reformat_number", "reformat_date", "normalize_boolean", "normalize_values",
    "fill_from_formula", "fill_from_column", "fill_from_formula_again", "fill_missing", "drop_column", "dedupe", "drop_rows",
]


def _fixes(f: Finding) -> list[Edit]:
    e = f.evidence
    match f.check:
        case "C15_formatted_numbers":
            return [Edit("reformat_number", f.column)]
        case "C16_mixed_date_formats":
            return [Edit("reformat_date", f.column, dayfirst=bool(e["dayfirst"]))]
        case "C17_inconsistent_booleans":
            return [Edit("normalize_boolean", f.column)]
        case "C18_out_of_band_code" | "C11_sentinel_values":
            return [Edit("blank_values", f.column, forms=tuple(e["forms"]))] if e["forms"] else []
        case "C14_untrimmed":
            return [Edit("trim")]
        case "C20_invisible_characters":
            return [Edit("strip_invisible")]
        case "C21_markup":
            return [Edit("strip_markup", f.column)]
        case "C5_categorical_inconsistency":
            return [Edit("normalize_values", f.column, forms=tuple(raws), to=to) for to, raws in e["canonical"].items() if raws]
        case "C12_functional_dependency":
            return [Edit("fill_from_column", f.column, source=e["source"], values=dict(e["mapping"]))]
        case "C13_arithmetic_relation":
            return [Edit("fill_from_formula", f.column, left=e["left"], right=e["right"], operation=e["operation"])] if e.get("operation") else []
        case "C1_missingness":
            return [Edit("fill_missing", f.column, to=e["fill_with"])] if f.action == "fill_missing" else []
        case "D1_exact_duplicates":
            return [Edit("dedupe")]
        case "C2_constant":
            return [Edit("drop_column", f.column)]
        case "D5_summary_row" | "C1_sparse_rows":
            return [Edit("drop_rows", rows=f.rows)]
    return []


def safe_fixes(findings: list[Finding]) -> list[Edit]:
    """The edits that need no decision by a person, in the order to apply them. Columns under suspicion are left alone."""
    contested = {f.column for f in findings if f.check in ("C10_leakage", "C3_id_like") and f.column}
    edits = [e for f in findings if f.column not in contested and f.evidence.get("auto_apply") is not False for e in _fixes(f)]
    edits += [again(e) for e in edits if e.op == "fill_from_formula"]
    return sorted(edits, key=lambda e: ORDER.index(e.order or e.op))
