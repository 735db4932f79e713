"""DuckDB SQL twins of the registered queries (the driver's correctness oracle).

Each statement starts from the same ``encounters`` specification (FIXTURES.md) and is written
independently in plain SQL; explicit casts keep types and float arithmetic aligned with Spark.
"""

from __future__ import annotations

from ..sources.fixtures import encounters_cte_sql

ORACLE: dict[str, str] = {}

# Constants of the rules, stated here once more so that a wrong one in the operators shows.
REQUIRED = ["race", "gender", "age", "admission_type_id", "discharge_disposition_id", "admission_source_id", "time_in_hospital",
            "num_lab_procedures", "num_medications", "number_diagnoses"]
LOWER = {"admission_type_id": 1, "discharge_disposition_id": 1, "admission_source_id": 1, "time_in_hospital": 1,
         "num_lab_procedures": 0, "num_medications": 0, "number_diagnoses": 1, "num_procedures": 0, "number_inpatient": 0}
UPPER = {"time_in_hospital": 14}
WARN = {"admission_type_id": (1, 8), "discharge_disposition_id": (1, 28), "admission_source_id": (1, 25),
        "num_lab_procedures": (0, 132), "num_procedures": (0, 6), "num_medications": (1, 81), "number_diagnoses": (1, 16)}
ALLOWED = {"gender": "Male Female Unknown/Invalid", "age": "[0-10) [10-20) [20-30) [30-40) [40-50) [50-60) [60-70) [70-80) [80-90) [90-100)",
           "max_glu_serum": ">200 >300 Norm", "A1Cresult": ">7 >8 Norm", "insulin": "No Down Steady Up"}
# P(Poisson(1) <= k), k = 0..11
POISSON = (0.367879441171, 0.735758882343, 0.919698602929, 0.981011843124, 0.996340153173, 0.999405815182,
           0.999916758851, 0.999989750803, 0.999998874797, 0.999999888575, 0.999999989952, 0.999999999168)


def icd9_group_sql(x: str) -> str:
    """Diagnosis chapters; codes that are no plain number, and V and E codes, are 'other'."""
    s = f"upper(trim({x}, e' \\t\\n\\r'))"
    n = f"try_cast(trunc(try_cast({s} as double)) as int)"
    return f"""case when {x} is null or {s} = '' then 'missing'
  when {s} like 'V%' or {s} like 'E%' then 'other' when {s} like '250%' then 'diabetes'
  when not regexp_full_match({s}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') then 'other'
  when {n} between 390 and 459 or {n} = 785 then 'circulatory' when {n} between 460 and 519 or {n} = 786 then 'respiratory'
  when {n} between 520 and 579 or {n} = 787 then 'digestive' when {n} between 800 and 999 then 'injury'
  when {n} between 710 and 739 then 'musculoskeletal' when {n} between 580 and 629 or {n} = 788 then 'genitourinary'
  when {n} between 140 and 239 then 'neoplasms' else 'other' end"""


E = encounters_cte_sql()
# The labelled cohort (P3 + P4) as an extra CTE.
COHORT = E + """,
cohort as (
  select * exclude (readmitted), cast(coalesce(cast(readmitted = '<30' as int), 0) as int) as label
  from encounters
  where not coalesce(discharge_disposition_id in (11, 13, 14, 19, 20, 21), false))"""

# Histogram + cumulative counts per group, then AUROC / AP.
def _ranking_sql(source: str, group: str, weight: str = "1") -> str:
    return f"""hist as (
  select {group}, score, cast(sum(case when label = 1 then {weight} else 0 end) as bigint) as pos,
         cast(sum(case when label = 1 then 0 else {weight} end) as bigint) as neg
  from {source} where score is not null and label is not null group by {group}, score),
cum as (
  select *, sum(pos) over (partition by {group} order by score desc rows between unbounded preceding and current row) as tp,
            sum(neg) over (partition by {group} order by score desc rows between unbounded preceding and current row) as fp
  from hist),
rm as (
  select {group}, cast(sum(pos) + sum(neg) as bigint) as n, cast(sum(pos) as bigint) as positives,
    case when sum(pos) > 0 and sum(neg) > 0 then
      (sum(cast(neg as double) * (tp - pos)) + 0.5 * sum(cast(neg as double) * pos)) / (cast(sum(pos) as double) * sum(neg)) end as auroc,
    case when sum(pos) > 0 and sum(neg) > 0 then
      sum(cast(pos as double) * tp / cast(tp + fp as double)) / sum(pos) end as auprc
  from cum group by {group})"""


ORACLE["cohort_label"] = COHORT + """
select encounter_id, patient_nbr, discharge_disposition_id, label from cohort"""

ORACLE["icd9_group"] = E + f"""
select encounter_id, diag_1, {icd9_group_sql('diag_1')} as diag_group from encounters"""

ORACLE["auroc_auprc"] = COHORT + ", " + _ranking_sql("cohort", "race") + """
select race, n, positives, round(auroc, 9) as auroc, round(auprc, 9) as auprc from rm"""

ORACLE["subgroup_metrics"] = COHORT + """,
sg as (
  select *, case age when '[0-10)' then '<40' when '[10-20)' then '<40' when '[20-30)' then '<40'
    when '[30-40)' then '<40' when '[40-50)' then '40-65' when '[50-60)' then '40-65'
    when '[60-70)' then '40-65' when '[70-80)' then '>65' when '[80-90)' then '>65'
    when '[90-100)' then '>65' end as subgroup from cohort),
sgn as (select * from sg where subgroup is not null),
stats as (
  select subgroup, count(*) as n, sum(label) as npos, avg(cast(label as double)) as prevalence,
         avg(score) as mean_pred from sgn group by subgroup), """ + _ranking_sql("sgn", "subgroup") + """
select s.subgroup, s.n, round(prevalence, 4) as prevalence, round(mean_pred, 4) as mean_pred,
       round(auroc, 4) as auroc, round(auprc, 4) as auprc
from stats s join rm using (subgroup)
where s.n >= 50 and s.npos >= 5 and s.n - s.npos >= 1"""


# --------------------------------------------------------------------------- shared SQL pieces
WS = "e' \\t\\n\\r'"
STRING_COLS = ["race", "gender", "age", "medical_specialty", "diag_1", "max_glu_serum", '"A1Cresult"',
               "insulin", "readmitted"]
NUMERIC = ["admission_type_id", "discharge_disposition_id", "admission_source_id", "time_in_hospital",
           "num_lab_procedures", "num_procedures", "num_medications", "number_inpatient", "number_diagnoses"]
# Declared category domain of the stand-in after preparation (FIXTURES.md), sorted by code point.
DOMAIN = {
    "race": ["AfricanAmerican", "Caucasian", "Hispanic", "Other", "unknown"],
    "gender": ["Female", "Male", "Unknown/Invalid"],
    "age": ["[0-10)", "[10-20)", "[20-30)", "[30-40)", "[40-50)", "[50-60)", "[60-70)", "[70-80)",
            "[80-90)", "[90-100)"],
    "medical_specialty": ["Cardiology", "Family/GeneralPractice", "InternalMedicine", "other", "unknown"],
    "diag_1": ["circulatory", "diabetes", "digestive", "genitourinary", "injury", "missing",
               "musculoskeletal", "neoplasms", "other", "respiratory"],
    "max_glu_serum": [">200", ">300", "Norm", "not_measured"],
    "A1Cresult": [">7", ">8", "Norm", "not_measured"],
    "insulin": ["Down", "No", "Steady", "Up"],
}


def _sanitize_py(name: str) -> str:
    import re
    return re.sub(r"[^A-Za-z0-9_]+", "_", name).strip("_")


def _q(c: str) -> str:
    return '"A1Cresult"' if c == "A1Cresult" else c


def _clean(c: str) -> str:
    t = f"trim({c}, {WS})"
    return f"case when {t} in ('', '?', 'None') then null else {t} end"


CLEAN = E + ",\nclean as (select * replace (" + ", ".join(f"{_clean(c)} as {c}" for c in STRING_COLS) + \
    ") from encounters)"
CLEAN_COHORT = CLEAN + """,
cohort as (
  select * exclude (readmitted), cast(coalesce(cast(readmitted = '<30' as int), 0) as int) as label
  from clean where not coalesce(discharge_disposition_id in (11, 13, 14, 19, 20, 21), false))"""
PREPARED = CLEAN_COHORT + f""",
prepared as (select * replace ({icd9_group_sql('diag_1')} as diag_1,
    coalesce("A1Cresult", 'not_measured') as "A1Cresult", coalesce(max_glu_serum, 'not_measured') as max_glu_serum,
    coalesce(race, 'unknown') as race, coalesce(medical_specialty, 'unknown') as medical_specialty) from cohort)"""
SPLIT = "case when b < 1500 then 'test' when b < 3000 then 'val' else 'train' end"
BUCKET = "(('0x' || substr(md5('42:' || cast(patient_nbr as varchar)), 1, 8))::bigint % 10000)"
PREPARED_SPLIT = PREPARED + f""",
psplit as (select * exclude (b), {SPLIT} as split from (select *, {BUCKET} as b from prepared))"""


def _collapse_sql(source: str) -> str:
    return f"""ms as (select medical_specialty as m, count(*) as n from {source} group by 1),
mtot as (select count(*) as ntot from {source}),
mmap as (select m, case when cast(n as double) < cast(0.01 as double) * ntot then 'other' else m end as mapped
         from ms, mtot)"""


def _one_hot_select(collapse: bool) -> str:
    cols = [f"coalesce(cast({c} as float), cast(0.0 as float)) as {c}" for c in NUMERIC]
    for col, cats in DOMAIN.items():
        src = "mmap.mapped" if (collapse and col == "medical_specialty") else f"p.{_q(col)}"
        for v in cats:
            name = _sanitize_py(f"{col}_{v}")
            cols.append(f"cast(coalesce({src} = '{v}', false) as float) as \"{name}\"")
    return ", ".join(cols)


ORACLE["trim_blank_to_null"] = CLEAN + """
select encounter_id, diag_1, "A1Cresult", medical_specialty from clean"""

ORACLE["fill_sentinels"] = PREPARED + """
select encounter_id, race, medical_specialty, "A1Cresult", max_glu_serum, diag_1 from prepared"""

ORACLE["rare_collapse"] = PREPARED + ",\n" + _collapse_sql("prepared") + """
select encounter_id, mapped as medical_specialty from prepared p join mmap on p.medical_specialty = mmap.m"""

ORACLE["one_hot"] = PREPARED + ",\n" + _collapse_sql("prepared") + f"""
select encounter_id, {_one_hot_select(True)} from prepared p join mmap on p.medical_specialty = mmap.m"""

ORACLE["align_manifest"] = PREPARED_SPLIT + f"""
select encounter_id, {_one_hot_select(False)} from psplit p where split = 'test'"""


def _vocab_sql(source: str, collapse: bool, name: str) -> str:
    parts = []
    for i, col in enumerate(DOMAIN):
        expr = "mapped" if (collapse and col == "medical_specialty") else _q(col)
        frm = f"{source} p join mmap on p.medical_specialty = mmap.m" if (collapse and col == "medical_specialty") \
            else source
        parts.append(f"select distinct {i} as ord, '{col}' as col, cast({expr} as varchar) as category from {frm} "
                     f"where {expr} is not null")
    nums = " union all ".join(f"select {i} as position, '{c}' as feature, '{c}' as col, cast(null as varchar) as category"
                              for i, c in enumerate(NUMERIC))
    return f"""{name}_c as ({' union all '.join(parts)}),
{name} as (
  {nums}
  union all
  select cast({len(NUMERIC)} + row_number() over (order by ord, category) - 1 as int) as position,
    regexp_replace(regexp_replace(col || '_' || category, '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') as feature,
    col, category from {name}_c)"""


ORACLE["sanitize_names"] = PREPARED + ",\n" + _collapse_sql("prepared") + ",\n" + _vocab_sql("prepared", True, "vocab") + """
select cast(position as int) as position, feature, col as "column", category from vocab"""

ORACLE["schema_drift"] = PREPARED_SPLIT + """,
tr as (select * from psplit where split = 'train'),
te as (select * from psplit where split = 'test'),
""" + _collapse_sql("tr") + ",\n" + _vocab_sql("tr", True, "ev") + ",\n" + _vocab_sql("te", False, "av") + """
select coalesce(e.feature, a.feature) as feature, cast(e.position as int) as expected_position,
  cast(a.position as int) as actual_position,
  case when a.position is null then 'only_expected' when e.position is null then 'only_actual'
       when e.position != a.position then 'moved' else 'ok' end as status
from ev e full outer join av a on e.feature = a.feature"""

_AGE_CASE = " ".join(f"when '{k}' then '{v}'" for k, v in {
    "[0-10)": "<40", "[10-20)": "<40", "[20-30)": "<40", "[30-40)": "<40", "[40-50)": "40-65",
    "[50-60)": "40-65", "[60-70)": "40-65", "[70-80)": ">65", "[80-90)": ">65", "[90-100)": ">65"}.items())
_AGE_CAT = " ".join(f"when '{k}' then '{v}'" for k, v in {
    "[0-10)": "young", "[10-20)": "young", "[20-30)": "young", "[30-40)": "young", "[40-50)": "midage",
    "[50-60)": "midage", "[60-70)": "senior", "[70-80)": "elderly", "[80-90)": "elderly",
    "[90-100)": "elderly"}.items())

ORACLE["age_brackets"] = E + f"""
select encounter_id, age, case age {_AGE_CASE} end as age_group,
  case when age is null then 'unknown' else (case age {_AGE_CAT} end) end as age_category from encounters"""

ORACLE["code_label"] = E + """
select encounter_id, gender, coalesce(case admission_type_id when 1 then 'Emergency' when 2 then 'Urgent'
  when 3 then 'Elective' end, 'Other') as admission_type
from encounters where coalesce(gender != 'Unknown/Invalid', true)"""

_BAND = "case when score < 0.1 then 'low' when score < 0.3 then 'moderate' when score is not null then 'high' end"
ORACLE["risk_band"] = E + f"""
select encounter_id, score, {_BAND} as risk_band, score / cast(0.1139 as double) as lift,
  case when score >= 0 and score < 0.1 then 'low' when score >= 0.1 and score < 0.2 then 'low_moderate'
       when score >= 0.2 and score < 0.3 then 'high_moderate' when score >= 0.3 and score < 1.001 then 'high' end
    as selection_band,
  coalesce(case lower({_BAND}) when 'low' then 'Standard discharge follow-up appropriate.'
    when 'moderate' then 'Consider scheduling a follow-up call within 7 days.'
    when 'high' then 'Recommend transitional care consult within 48h of discharge.' end, '') as action
from encounters"""

ORACLE["clean_vocab"] = E + """
select encounter_id,
  case when "A1Cresult" in ('>7', '>8', 'Norm') then "A1Cresult" end as "A1Cresult",
  case when max_glu_serum in ('>200', '>300', 'Norm') then max_glu_serum end as max_glu_serum,
  case when insulin in ('No', 'Down', 'Steady', 'Up') then insulin end as insulin,
  case when gender in ('Male', 'Female', 'Unknown/Invalid') then gender end as gender
from encounters"""


def _validate_sql(base: str = E, source: str = "encounters", tail: bool = True) -> str:
    cols = set(["race", "gender", "age", "admission_type_id", "discharge_disposition_id", "admission_source_id",
                "time_in_hospital", "medical_specialty", "num_lab_procedures", "num_procedures", "num_medications",
                "number_inpatient", "number_diagnoses", "diag_1", "max_glu_serum", "A1Cresult", "insulin"])

    def present(c):
        s = f"cast({_q(c)} as varchar)"
        return f"({_q(c)} is not null and trim({s}, {WS}) != '' and lower({s}) != 'nan')"
    errs = [f"case when not {present(f)} then '{f}: field required' end" for f in REQUIRED]
    errs += [f"case when coalesce({_q(f)} < {lo}, false) then '{f}: must be >= {lo}' end"
             for f, lo in LOWER.items() if f in cols]
    errs += [f"case when coalesce({_q(f)} > {hi}, false) then '{f}: must be <= {hi}' end"
             for f, hi in UPPER.items() if f in cols]
    for f, allowed in ALLOWED.items():
        if f in cols:
            lst = ", ".join(f"'{a}'" for a in allowed.split())
            errs.append(f"case when {_q(f)} is not null and not {_q(f)} in ({lst}) then '{f}: value not allowed' end")
    warns = [f"case when coalesce({_q(f)} < {lo} or {_q(f)} > {hi}, false) then '{f}: outside {lo}-{hi}' end"
             for f, (lo, hi) in WARN.items() if f in cols]
    valid_row = " and ".join(present(f) for f in REQUIRED) + " and coalesce(gender in ('Male', 'Female', 'Unknown/Invalid'), false)"
    body = base + f""",
v as (select encounter_id, list_filter([{', '.join(errs)}], lambda x: x is not null) as errs,
             list_filter([{', '.join(warns)}], lambda x: x is not null) as warns,
             ({valid_row}) as valid_row from {source})"""
    if not tail:
        return body
    return body + """
select encounter_id, len(errs) = 0 as valid, cast(len(errs) as bigint) as n_errors,
  array_to_string(errs, '; ') as errors, array_to_string(warns, '; ') as warnings, valid_row from v"""


ORACLE["validate_rules"] = _validate_sql()


# --------------------------------------------------------------------------- split / profile / metrics
COHORT_SPLIT = CLEAN_COHORT + f""",
csplit as (select * exclude (b), {SPLIT} as split from (select *, {BUCKET} as b from cohort))"""

ORACLE["group_split"] = COHORT_SPLIT + """
select split, count(*) as rows, count(distinct patient_nbr) as groups, avg(cast(label as double)) as positive_rate
from csplit group by split"""

ORACLE["leakage_check"] = CLEAN_COHORT + f""",
naive as (select patient_nbr, {SPLIT} as split from (select *, {BUCKET.replace('patient_nbr', 'encounter_id')} as b from cohort)),
s as (select distinct patient_nbr, split from naive),
pairs as (select a.split || '&' || b.split as pair from s a join s b on a.patient_nbr = b.patient_nbr and a.split < b.split)
select pair, count(*) as shared_groups from pairs group by pair"""

ORACLE["raw_rows_of_split"] = COHORT_SPLIT + """
select encounter_id, patient_nbr, age, diag_1, readmitted from encounters
where encounter_id in (select encounter_id from csplit where split = 'test')"""


def _age_audit_sql(source: str) -> str:
    return f"""sg as (select *, case age {_AGE_CASE} end as subgroup from {source}),
sgn as (select * from sg where subgroup is not null),
stats as (select subgroup, count(*) as n, sum(label) as npos, avg(cast(label as double)) as prevalence,
                 avg(score) as mean_pred from sgn group by subgroup),
{_ranking_sql("sgn", "subgroup")},
aud as (select s.subgroup, s.n, round(prevalence, 4) as prevalence, round(mean_pred, 4) as mean_pred,
               round(auroc, 4) as auroc, round(auprc, 4) as auprc
        from stats s join rm using (subgroup) where s.n >= 50 and s.npos >= 5 and s.n - s.npos >= 1)"""


ORACLE["subgroup_footnote"] = COHORT_SPLIT + ",\n" + _age_audit_sql("cohort") + f"""
select t.encounter_id, t.age_group, aud.n, aud.auroc
from (select encounter_id, case age {_AGE_CASE} end as age_group from csplit where split = 'test') t
left join aud on t.age_group = aud.subgroup"""

_ALL_COLS = ["encounter_id", "patient_nbr", "race", "gender", "age", "admission_type_id", "discharge_disposition_id",
             "admission_source_id", "time_in_hospital", "medical_specialty", "num_lab_procedures", "num_procedures",
             "num_medications", "number_inpatient", "number_diagnoses", "diag_1", "max_glu_serum", "A1Cresult",
             "insulin", "readmitted", "prior_n", "o_orderdate", "score"]
ORACLE["missing_profile"] = CLEAN + """,
nc as (""" + " union all ".join(
    f"select '{c}' as \"column\", count(*) as rows, count(*) - count({_q(c)}) as nulls from clean" for c in _ALL_COLS) + """)
select "column", rows, nulls, cast(nulls as double) / rows as missing_fraction from nc
where cast(nulls as double) / rows > 0.005"""

ORACLE["value_counts"] = CLEAN + """
select medical_specialty as value, count(*) as n,
  cast(count(*) as double) / (select count(*) from clean where medical_specialty is not null) as share
from clean where medical_specialty is not null group by medical_specialty"""

ORACLE["entity_histogram"] = CLEAN_COHORT + """
select rows_per_entity, count(*) as entities from
  (select patient_nbr, count(*) as rows_per_entity from cohort group by patient_nbr) group by rows_per_entity"""

ORACLE["entity_summary"] = CLEAN_COHORT + """
select count(*) as rows, count(distinct patient_nbr) as entities,
  cast(count(*) as double) / count(distinct patient_nbr) as rows_per_entity from cohort"""

_CATS = ["race", "gender", "age", "medical_specialty", "diag_1", "max_glu_serum", "A1Cresult", "insulin"]
ORACLE["cardinality"] = CLEAN + "\n" + " union all ".join(
    f"select '{c}' as \"column\", count(distinct {_q(c)}) as distinct_values from clean" for c in _CATS)

ORACLE["label_corr"] = CLEAN_COHORT + "\nselect \"column\", round(c, 9) as corr, round(abs(c), 9) as abs_corr from (" + \
    " union all ".join(
        f"select '{c}' as \"column\", case when stddev_pop(cast({c} as double)) > 0 and stddev_pop(cast(label as double)) > 0 "
        f"then corr(cast({c} as double), cast(label as double)) end as c from cohort"
        for c in NUMERIC + ["score"]) + ")"

ORACLE["density_hist"] = CLEAN_COHORT + """,
long as (select 'num_lab_procedures' as "column", label, cast(num_lab_procedures as double) as x from cohort
         union all select 'num_medications', label, cast(num_medications as double) from cohort),
b as (select "column", label, floor(x / 10.0) * 10.0 as bin_start from long where x is not null),
cnt as (select "column", label, bin_start, count(*) as n from b group by all),
tot as (select "column", label, count(*) as n_class from b group by all)
select cnt."column", cnt.label, bin_start, n, n / (n_class * 10.0) as density
from cnt join tot on cnt."column" = tot."column" and cnt.label = tot.label"""

_HIST_ALL = """hist as (
  select score, cast(sum(case when label = 1 then 1 else 0 end) as bigint) as pos,
         cast(sum(case when label = 1 then 0 else 1 end) as bigint) as neg
  from {src} where score is not null and label is not null group by score),
cum as (select *, cast(sum(pos) over (order by score desc rows between unbounded preceding and current row) as bigint) as tp,
                  cast(sum(neg) over (order by score desc rows between unbounded preceding and current row) as bigint) as fp
        from hist)"""
ORACLE["roc_curve"] = CLEAN_COHORT + ",\n" + _HIST_ALL.format(src="cohort") + """
select score as threshold, tp, fp, cast(tp as double) / (select sum(pos) from hist) as tpr,
  cast(fp as double) / (select sum(neg) from hist) as fpr,
  cast(tp as double) / (tp + fp) as precision from cum"""

_SPLIT_CURVE = """hist as (
  select split, score, cast(sum(case when label = 1 then 1 else 0 end) as bigint) as pos,
         cast(sum(case when label = 1 then 0 else 1 end) as bigint) as neg
  from csplit where score is not null and label is not null group by split, score),
cum as (select *, sum(pos) over (partition by split order by score desc rows between unbounded preceding and current row) as tp,
                  sum(neg) over (partition by split order by score desc rows between unbounded preceding and current row) as fp
        from hist),
tot as (select split, sum(pos) as P from hist group by split),
f as (select c.split, score, cast(tp as double) / (tp + fp) as pr,
        case when P > 0 then cast(tp as double) / P else 0.0 end as re from cum c join tot using (split)),
f1 as (select split, score, case when pr + re > 0 then 2 * pr * re / (pr + re + cast(1e-12 as double)) else 0.0 end as f1 from f),
bf as (select split, arg_max(f1, row(round(f1, 12), -score)) as best_f1,
              arg_max(score, row(round(f1, 12), -score)) as best_threshold from f1 group by split)"""
ORACLE["best_f1"] = COHORT_SPLIT + ",\n" + _SPLIT_CURVE + """
select split, round(best_f1, 9) as best_f1, best_threshold from bf"""

ORACLE["metric_bundle"] = COHORT_SPLIT + ",\n" + _SPLIT_CURVE + """,
rm as (select split,
    (sum(cast(neg as double) * (tp - pos)) + 0.5 * sum(cast(neg as double) * pos)) / (cast(sum(pos) as double) * sum(neg)) as auroc,
    sum(cast(pos as double) * tp / cast(tp + fp as double)) / sum(pos) as auprc from cum group by split),
br as (select split, avg(power(score - label, 2)) as brier from csplit group by split)
select split, round(auroc, 9) as auroc, round(auprc, 9) as auprc, round(brier, 9) as brier,
  round(best_f1, 9) as best_f1, round(best_threshold, 9) as best_threshold
from rm join br using (split) join bf using (split)"""

ORACLE["confusion"] = COHORT_SPLIT + """,
c as (select split, t as threshold,
        count(*) filter (where score >= t and label = 1) as tp, count(*) filter (where score >= t and label != 1) as fp,
        count(*) filter (where score < t and label != 1) as tn, count(*) filter (where score < t and label = 1) as fn
      from csplit, (select unnest([0.1, 0.2, 0.3, 0.5]::double[]) as t) group by split, t)
select split, threshold, tp, fp, tn, fn,
  case when tp + fp > 0 then cast(tp as double) / (tp + fp) else 0.0 end as precision,
  case when tp + fn > 0 then cast(tp as double) / (tp + fn) else 0.0 end as recall,
  case when tn + fp > 0 then cast(tn as double) / (tn + fp) else 0.0 end as specificity,
  case when tp + fn > 0 and tp + fp > 0 then (cast(tp as double) / (tp + fp)) / (cast(tp + fn as double) / (tp + fp + tn + fn)) else 0.0 end as lift
from c"""

_CAL_BIN = " + ".join(f"case when cast({i} as double) * cast(0.1 as double) < score then 1 else 0 end" for i in range(1, 10))
ORACLE["calibration"] = COHORT_SPLIT + f"""
select split, cast({_CAL_BIN} as int) as bin, count(*) as n, round(avg(score), 9) as mean_pred,
  avg(cast(label as double)) as observed_rate
from csplit where score is not null group by split, bin"""

ORACLE["calibration_large"] = COHORT_SPLIT + """
select split, count(*) as n, round(avg(score), 9) as mean_pred, avg(cast(label as double)) as observed_rate,
  round(avg(score) - avg(cast(label as double)), 9) as calibration_gap, round(avg(power(score - label, 2)), 9) as brier
from csplit group by split"""

_DIMS = CLEAN_COHORT + f""",
dims as (
  select encounter_id, score, label, 'age_group' as dimension, case age {_AGE_CASE} end as subgroup from cohort
  union all select encounter_id, score, label, 'gender', case when gender != 'Unknown/Invalid' then gender end from cohort
  union all select encounter_id, score, label, 'race', race from cohort
  union all select encounter_id, score, label, 'admission_type', coalesce(case admission_type_id when 1 then 'Emergency'
    when 2 then 'Urgent' when 3 then 'Elective' end, 'Other') from cohort),
dn as (select * from dims where subgroup is not null),
stats as (select dimension, subgroup, count(*) as n, sum(label) as npos, avg(cast(label as double)) as prevalence,
                 avg(score) as mean_pred from dn group by dimension, subgroup),
{_ranking_sql("dn", "dimension, subgroup")},
aud as (select s.dimension, s.subgroup, s.n, round(prevalence, 4) as prevalence, round(mean_pred, 4) as mean_pred,
               round(auroc, 4) as auroc, round(auprc, 4) as auprc
        from stats s join rm using (dimension, subgroup) where s.n >= 50 and s.npos >= 5 and s.n - s.npos >= 1)"""
ORACLE["multi_audit"] = _DIMS + "\nselect * from aud"
ORACLE["audit_disparity"] = _DIMS + """
select dimension, count(*) as groups, round(max(auroc) - min(auroc), 4) as auroc_spread from aud group by dimension"""


def _bootstrap_sql() -> str:
    alpha = (1.0 - 0.95) / 2.0
    return CLEAN_COHORT + f""",
ag as (select encounter_id, score, label, case age {_AGE_CASE} end as age_group from cohort
       where (case age {_AGE_CASE} end) is not null),
{_replicates_sql("ag", 1000)},
{_ranking_sql("repw", "age_group, replicate", "w")},
ci as (select age_group, count(auroc) as n_ok,
         quantile_cont(auroc, {alpha!r}) as al, quantile_cont(auroc, {1.0 - alpha!r}) as ah,
         quantile_cont(auprc, {alpha!r}) as pl, quantile_cont(auprc, {1.0 - alpha!r}) as ph from rm group by age_group),
pt as ({_POINT})
select age_group, cast(round(cast(pt.auroc as decimal(18,9)), 3) as double) as auroc, cast(round(cast(pt.auprc as decimal(18,9)), 3) as double) as auprc, cast(1000 - n_ok as bigint) as skipped,
  case when (1000 - n_ok) / 1000.0 <= 0.1 then cast(round(cast(al as decimal(18,9)), 3) as double) end as auroc_ci_low,
  case when (1000 - n_ok) / 1000.0 <= 0.1 then cast(round(cast(ah as decimal(18,9)), 3) as double) end as auroc_ci_high,
  case when (1000 - n_ok) / 1000.0 <= 0.1 then cast(round(cast(pl as decimal(18,9)), 3) as double) end as auprc_ci_low,
  case when (1000 - n_ok) / 1000.0 <= 0.1 then cast(round(cast(ph as decimal(18,9)), 3) as double) end as auprc_ci_high
from ci join pt using (age_group)"""


# The point estimate by pairs, without a histogram: AUROC from average ranks, AP from the precision at each positive.
_POINT = """select age_group,
    (sum(case when label = 1 then r end) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) as auroc,
    avg(case when label = 1 then prec end) as auprc
  from (select age_group, label,
          rank() over (partition by age_group order by score) + (count(*) over (partition by age_group, score) - 1) / 2.0 as r,
          cast(sum(label) over w as double) / count(*) over w as prec
        from ag where score is not null and label is not null
        window w as (partition by age_group order by score desc range between unbounded preceding and current row))
  group by age_group"""

ORACLE["class_weights"] = COHORT_SPLIT + """
select label, count(*) as n, (select count(*) from csplit where split = 'train') / (2.0 * count(*)) as weight
from csplit where split = 'train' group by label"""


# --------------------------------------------------------------------------- sampling
def _unit(key: str) -> str:
    return f"(('0x' || substr(md5('42:' || cast({key} as varchar)), 1, 8))::bigint / 4294967296.0)"


ORACLE["diverse_sample"] = PREPARED_SPLIT + f""",
cand as (
  select encounter_id, {_unit('encounter_id')} as h,
    case when score >= 0 and score < 0.1 then 'low' when score >= 0.1 and score < 0.2 then 'low_moderate'
         when score >= 0.2 and score < 0.3 then 'high_moderate' when score >= 0.3 and score < 1.001 then 'high' end as band,
    coalesce(diag_1, 'missing') || '_' || coalesce(case when age is null then 'unknown' else (case age {_AGE_CAT} end) end, 'unknown') as grp
  from psplit where split = 'test'),
c2 as (select * from cand where band is not null),
r as (select *, row_number() over (partition by band, grp order by h, encounter_id) as group_rank,
             count(*) over (partition by band, grp) as group_size from c2),
p as (select *, row_number() over (partition by band order by group_rank, group_size desc, grp) as pick_order
      from r where group_rank <= 5)
select band, cast(pick_order as int) as pick_order, encounter_id, grp, cast(group_rank as int) as group_rank,
  cast(group_size as bigint) as group_size from p where pick_order <= 5"""

ORACLE["seeded_sample"] = CLEAN_COHORT + f"""
select encounter_id, patient_nbr, score from cohort order by {_unit('encounter_id')}, encounter_id limit 5000"""

ORACLE["extreme_rows"] = COHORT_SPLIT + """,
t as (select * from csplit where split = 'test' and score is not null)
select 'highest_risk' as pick, arg_max(encounter_id, row(score, -encounter_id)) as "key",
  arg_max(score, row(score, -encounter_id)) as score, arg_max(label, row(score, -encounter_id)) as label from t
union all
select 'true_negative_near_target', arg_min(encounter_id, row(abs(score - 0.05), encounter_id)),
  arg_min(score, row(abs(score - 0.05), encounter_id)), arg_min(label, row(abs(score - 0.05), encounter_id))
from t where label = 0"""


def _first_valid_sql() -> str:

    def present(c):
        s = f"cast({_q(c)} as varchar)"
        return f"({_q(c)} is not null and trim({s}, {WS}) != '' and lower({s}) != 'nan')"
    cond = " and ".join(present(f) for f in REQUIRED) + " and gender in ('Male', 'Female', 'Unknown/Invalid')"
    return CLEAN + f"""
select encounter_id, race, gender, age from clean where {cond} order by encounter_id limit 10"""


ORACLE["first_valid"] = _first_valid_sql()

# --------------------------------------------------------------------------- scorer / explanations
_W = [("number_inpatient", 0.35, 1.0), ("time_in_hospital", 0.04, 7.5), ("num_medications", 0.01, 40.0),
      ("number_diagnoses", 0.05, 8.5), ("diag_1_circulatory", 0.15, 0.3), ("diag_1_diabetes", 0.10, 0.08),
      ("A1Cresult__8", 0.20, 0.14), ("insulin_Up", 0.12, 0.25), ("age__70_80", 0.08, 0.1)]
_X = {"number_inpatient": "cast(coalesce(cast(number_inpatient as float), cast(0.0 as float)) as double)",
      "time_in_hospital": "cast(coalesce(cast(time_in_hospital as float), cast(0.0 as float)) as double)",
      "num_medications": "cast(coalesce(cast(num_medications as float), cast(0.0 as float)) as double)",
      "number_diagnoses": "cast(coalesce(cast(number_diagnoses as float), cast(0.0 as float)) as double)",
      "diag_1_circulatory": "cast(cast(coalesce(diag_1 = 'circulatory', false) as float) as double)",
      "diag_1_diabetes": "cast(cast(coalesce(diag_1 = 'diabetes', false) as float) as double)",
      "A1Cresult__8": "cast(cast(coalesce(\"A1Cresult\" = '>8', false) as float) as double)",
      "insulin_Up": "cast(cast(coalesce(insulin = 'Up', false) as float) as double)",
      "age__70_80": "cast(cast(coalesce(age = '[70-80)', false) as float) as double)"}
_BASE_VALUE = -3.0 + sum(w * m for _, w, m in _W)
_MARGIN = "cast(-3.0 as double)" + "".join(f" + cast({w!r} as double) * x_{f}" for f, w, _ in _W)
_XCOLS = ", ".join(f"{_X[f]} as x_{f}" for f, _, _ in _W)
_LONG = " union all ".join(
    f"select encounter_id, {i} as position, '{f}' as feature, cast({w!r} as double) * (x_{f} - cast({m!r} as double)) as value, "
    f"x_{f} as feature_value from xs" for i, (f, w, m) in enumerate(_W))
SCORED = PREPARED_SPLIT + f""",
xs as (select encounter_id, split, {_XCOLS} from psplit),
lng as ({_LONG}),
topk as (select *, row_number() over (partition by encounter_id order by abs(value) desc, position) as rk from lng)"""

ORACLE["linear_attribution_topk"] = SCORED + """
select encounter_id, cast(rk as int) as rank, feature, round(value, 9) as value, feature_value from topk where rk <= 5"""

ORACLE["attribution_importance"] = SCORED + """
select cast(position as int) as position, feature, round(avg(abs(value)), 9) as mean_abs_contribution
from lng group by position, feature"""

ORACLE["additivity_check"] = SCORED + f""",
m as (select encounter_id, {_MARGIN} as margin from xs),
s as (select encounter_id, sum(value) as tot from lng group by encounter_id)
select encounter_id, round(cast({_BASE_VALUE!r} as double) + tot, 9) + cast(0.0 as double) as attributed, round(margin, 9) + cast(0.0 as double) as margin
from m join s using (encounter_id)"""

ORACLE["waterfall"] = SCORED + f""",
m as (select encounter_id, {_MARGIN} as margin from xs where split = 'test'),
top1 as (select arg_max(encounter_id, row(margin, -encounter_id)) as k from m),
steps as (select encounter_id, feature, value,
            row_number() over (partition by encounter_id order by abs(value) desc, position) as step
          from lng where encounter_id = (select k from top1))
select encounter_id, cast(step as int) as step, feature, round(value, 9) as value,
  round(cast({_BASE_VALUE!r} as double) + sum(value) over (partition by encounter_id order by step
        rows between unbounded preceding and current row), 9) as running_total from steps"""

ORACLE["beeswarm"] = SCORED + """,
imp as (select feature, avg(abs(value)) as mabs from lng group by feature order by mabs desc, feature limit 20)
select encounter_id, feature, round(value, 9) as value, feature_value from lng where feature in (select feature from imp)"""

_DISPLAY = {"number_inpatient": "Prior inpatient admissions", "time_in_hospital": "Days in hospital",
            "num_medications": "Medications at discharge", "number_diagnoses": "Number of diagnoses",
            "diag_1_circulatory": "Primary diagnosis: circulatory", "diag_1_diabetes": "Primary diagnosis: diabetes",
            "insulin_Up": "Insulin increased"}
# Title case: a letter is upper-case unless the character before it is a letter.
_TITLE = """array_to_string(list_transform(range(1, length(t) + 1), lambda i:
    case when i > 1 and regexp_matches(t[i - 1], '[A-Za-z]') then lower(t[i]) else upper(t[i]) end), '')"""
_DISPLAY_CASE = "case feature " + " ".join(f"when '{k}' then '{v}'" for k, v in _DISPLAY.items()) + f" else {_TITLE} end"
ORACLE["feature_labels"] = SCORED + f""",
tt as (select *, replace(feature, '_', ' ') as t, feature_value + 1 as v from topk where rk <= 5),
nn as (select *, 120.4::double * v as a, 100.3::double * v as b, 999.7::double * v as c, 0.00012345::double * v as d from tt)
select encounter_id, cast(rk as int) as rank,
  {_DISPLAY_CASE} || ' (' || cast(cast(feature_value as bigint) as varchar) || ')' as label,
  {', '.join(f"case when {x} = floor({x}) then cast(cast({x} as bigint) as varchar) else printf('%.3g', {x}) end as text_{x}" for x in "abcd")}
from nn"""

_PLATT = "(1.0 / (1.0 + exp(-(cast(5.38 as double) * {p} + cast(-2.72 as double)))))"
ORACLE["platt_apply"] = CLEAN_COHORT + f"""
select encounter_id, round({_PLATT.format(p='score')}, 9) as calibrated,
  case when {_PLATT.format(p='score')} < 0.1 then 'low' when {_PLATT.format(p='score')} < 0.3 then 'moderate' else 'high' end as risk_band
from cohort"""


def _bundle_sql(src: str, g: str) -> str:
    return f"""bh as (
  select {g}, p as score, cast(sum(case when label = 1 then 1 else 0 end) as bigint) as pos,
         cast(sum(case when label = 1 then 0 else 1 end) as bigint) as neg
  from {src} where p is not null and label is not null group by {g}, p),
bc as (select *, sum(pos) over (partition by {g} order by score desc rows between unbounded preceding and current row) as tp,
                 sum(neg) over (partition by {g} order by score desc rows between unbounded preceding and current row) as fp
       from bh),
bt as (select {g}, sum(pos) as P from bh group by {g}),
bfq as (select *, cast(tp as double) / (tp + fp) as pr, case when P > 0 then cast(tp as double) / P else 0.0 end as re
        from bc join bt using ({g})),
bf1 as (select *, case when pr + re > 0 then 2 * pr * re / (pr + re + cast(1e-12 as double)) else 0.0 end as f1 from bfq),
bbest as (select {g}, arg_max(f1, row(round(f1, 12), -score)) as best_f1,
                 arg_max(score, row(round(f1, 12), -score)) as best_threshold from bf1 group by {g}),
brm as (select {g},
    (sum(cast(neg as double) * (tp - pos)) + 0.5 * sum(cast(neg as double) * pos)) / (cast(sum(pos) as double) * sum(neg)) as auroc,
    sum(cast(pos as double) * tp / cast(tp + fp as double)) / sum(pos) as auprc from bc group by {g}),
bbr as (select {g}, avg(power(p - label, 2)) as brier from {src} group by {g}),
bundle as (select * from brm join bbr using ({g}) join bbest using ({g}))"""


ORACLE["model_compare"] = COHORT_SPLIT + f""",
lm as (select split, label, 'raw' as model, score as p from csplit
       union all select split, label, 'platt', {_PLATT.format(p='score')} from csplit),
{_bundle_sql("lm", "model, split")}
select b.model, b.split, round(b.auroc, 9) as auroc, round(b.auprc, 9) as auprc, round(b.brier, 9) as brier,
  round(b.best_f1, 9) as best_f1, round(b.best_threshold, 9) as best_threshold,
  round(b.auroc - r.auroc, 9) as auroc_delta, round(b.brier - r.brier, 9) as brier_delta
from bundle b left join (select split, auroc, brier from bundle where model = 'raw') r using (split)"""

_SCORE_BASE = _validate_sql(PREPARED_SPLIT, "clean", tail=False) + f""",
pall as (select * replace ({icd9_group_sql('diag_1')} as diag_1) from clean),
xa as (select encounter_id, {_XCOLS} from pall),
pa as (select encounter_id, {_PLATT.format(p=f"(1.0 / (1.0 + exp(-({_MARGIN}))))")} as p from xa),
sb as (select md5('batch|' || cast(v.encounter_id as varchar)) as request_id, v.encounter_id as row_key,
         len(errs) = 0 as valid, cast(len(errs) as bigint) as n_errors,
         case when len(errs) = 0 then p end as probability,
         case when len(errs) = 0 then (case when p < 0.1 then 'low' when p < 0.3 then 'moderate' else 'high' end) end as risk_band
       from v join pa on v.encounter_id = pa.encounter_id)"""
ORACLE["scored_batch"] = _SCORE_BASE + """
select request_id, row_key, valid, n_errors, round(probability, 9) as probability, risk_band from sb"""
ORACLE["batch_summary"] = _SCORE_BASE + """
select risk_band, count(*) as n from sb group by risk_band"""

# W3 + S7: picks by the model's probability among valid test rows, as JSON records.
_FIELDS = ("race gender age admission_type_id discharge_disposition_id admission_source_id time_in_hospital medical_specialty "
           "num_lab_procedures num_procedures num_medications number_inpatient number_diagnoses diag_1 max_glu_serum A1Cresult insulin").split()
_EXPORTED = {"A1Cresult": ">7 >8 Norm", "max_glu_serum": ">200 >300 Norm", "insulin": "No Down Steady Up"}


def _exported(c: str) -> str:
    allowed = ", ".join(f"'{v}'" for v in _EXPORTED.get(c, "").split())
    return f"case when {_q(c)} in ({allowed}) then {_q(c)} end" if allowed else _q(c)


ORACLE["sample_export"] = _validate_sql(SCORED, "cohort", tail=False) + f""",
pr as (select encounter_id, {_PLATT.format(p=f"(1.0 / (1.0 + exp(-({_MARGIN}))))")} as p from xs where split = 'test'),
cand as (select c.*, p, {_unit('encounter_id')} as h, {icd9_group_sql('diag_1')} as bucket,
    case when age is null then 'unknown' else (case age {_AGE_CAT} end) end as cat,
    case when p >= 0 and p < 0.1 then 'low' when p >= 0.1 and p < 0.2 then 'low_moderate'
         when p >= 0.2 and p < 0.3 then 'high_moderate' when p >= 0.3 and p < 1.001 then 'high' end as band
  from cohort c join pr using (encounter_id) join v using (encounter_id) where valid_row),
g as (select *, bucket || '_' || coalesce(cat, 'unknown') as grp from cand where band is not null),
r as (select *, row_number() over (partition by band, grp order by h, encounter_id) as group_rank,
             count(*) over (partition by band, grp) as group_size from g),
k as (select *, row_number() over (partition by band order by group_rank, group_size desc, grp) as pick_order from r where group_rank <= 5)
select encounter_id, cast(to_json(struct_pack(label_internal := concat_ws('_', band, cat, bucket),
    fields := struct_pack({', '.join(f'{_q(c)} := {_exported(c)}' for c in _FIELDS)}),
    expected_band := case band when 'low' then 'low' when 'high' then 'high' else 'moderate' end,
    model_predicted := round(p, 4))) as varchar) as record
from k where pick_order <= 5"""

# The literal ensemble by hand: value functions v(S) of each tree (cover-weighted where a feature is not in S) and
# two-player Shapley values; log-odds are twice the weighted sum of trees.
_ENSEMBLE = """
  case when i <= 1.5 then (case when h <= 7.5 then -0.9::double else -0.5::double end) else 0.3::double end as a_all,
  case when i <= 1.5 then (-0.9::double * 30 + -0.5::double * 20) / 50 else 0.3::double end as a_i,
  (case when h <= 7.5 then -0.9::double else -0.5::double end) * 0.5 + 0.3::double * 0.5 as a_h,
  ((-0.9::double * 30 + -0.5::double * 20) + 0.3::double * 50) / 100 as a_none,
  case when m <= 40.5 then -0.6::double when i <= 3.5 then 0.1::double else 0.8::double end as b_all,
  case when m <= 40.5 then -0.6::double else (0.1::double * 25 + 0.8::double * 15) / 40 end as b_m,
  -0.6::double * 0.6 + (case when i <= 3.5 then 0.1::double else 0.8::double end) * 0.4 as b_i,
  (-0.6::double * 60 + 0.1::double * 25 + 0.8::double * 15) / 100 as b_none"""
_TREE_X = "coalesce(cast(number_inpatient as double), 0) as i, cast(time_in_hospital as double) as h, cast(num_medications as double) as m"
ORACLE["tree_scored_batch"] = _validate_sql(CLEAN, "clean", tail=False) + f""",
tx as (select encounter_id, len(errs) = 0 as valid, {_TREE_X} from clean join v using (encounter_id)),
tf as (select *, {_ENSEMBLE} from tx),
ts as (select *, 1.0 / (1.0 + exp(-2 * (a_all + 0.5 * b_all))) as raw from tf),
tq as (select *, {_PLATT.format(p='raw')} as p from ts),
lng as (select encounter_id, 0 as position, 'number_inpatient' as feature, i as feature_value,
          2 * (0.5 * ((a_i - a_none) + (a_all - a_h)) + 0.5 * 0.5 * ((b_i - b_none) + (b_all - b_m))) as value from tq where valid
  union all select encounter_id, 1, 'time_in_hospital', h, 2 * 0.5 * ((a_h - a_none) + (a_all - a_i)) from tq where valid
  union all select encounter_id, 2, 'num_medications', m, 2 * 0.5 * 0.5 * ((b_m - b_none) + (b_all - b_i)) from tq where valid),
rk as (select *, row_number() over (partition by encounter_id order by round(abs(value), 12) desc, position) - 1 as r from lng)
select q.encounter_id as row_key, case when valid then round(p, 9) end as probability,
  case when valid then (case when p < 0.1 then 'low' when p < 0.3 then 'moderate' else 'high' end) end as risk_band,
  cast(r as int) as rank, feature, round(value, 9) + cast(0.0 as double) as value, feature_value
from tq as q left join rk using (encounter_id)"""

ORACLE["tree_ensemble_auroc"] = COHORT_SPLIT + f""",
x as (select label, {_TREE_X} from csplit where split = 'val'),
f as (select label, {_ENSEMBLE} from x),
z as (select label, 1 as iteration, a_all as z from f union all select label, 2, a_all + 0.5 * b_all from f),
g as (select iteration, label, least(floor(16384 / (1 + exp(-2 * z))), 16383) as s from z),
r as (select iteration, label, rank() over (partition by iteration order by s) + (count(*) over (partition by iteration, s) - 1) / 2.0 as r from g)
select cast(iteration as int) as iteration, round((sum(case when label = 1 then r end) - sum(label) * (sum(label) + 1) / 2.0)
  / (cast(sum(label) as double) * (count(*) - sum(label))), 9) as auroc from r group by iteration"""

ORACLE["latest_run"] = COHORT_SPLIT + """,
cr as (select * from csplit where race is not null),
""" + _ranking_sql("cr", "split, race") + """,
st as (select split, race, max(o_orderdate) as start_time from cr group by split, race),
log as (select rm.split as name, rm.race as run_id, start_time, auroc from rm join st using (split, race))
select name, arg_max(run_id, row(start_time, run_id)) as run_id,
  strftime(max(start_time), '%Y-%m-%d %H:%M:%S') as start_time,
  round(arg_max(auroc, row(start_time, run_id)), 9) as auroc from log group by name"""

ORACLE["latency_summary"] = """
select event_type, count(value) as n, round(quantile_cont(value, 0.5), 9) as p50,
  round(quantile_cont(value, 0.95), 9) as p95, round(quantile_cont(value, 0.99), 9) as p99,
  round(avg(value), 9) as mean, round(stddev_samp(value), 9) as stdev
from events group by event_type"""

ORACLE["audit_rollup"] = """
select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n,
  round(avg(value), 9) as mean_value, max(value) as max_value
from events group by all"""

ORACLE["manifest_hash"] = PREPARED + ",\n" + _collapse_sql("prepared") + ",\n" + _vocab_sql("prepared", True, "vocab") + """
select count(*) as n_features, sha256('[' || array_to_string(list_transform(list_sort(list(feature)), lambda f: '"' || f || '"'), ', ') || ']') as columns_sha256 from vocab"""

# X2 in complete mode equals the batch rollup.
ORACLE["stream_rollup"] = ORACLE["audit_rollup"]


def _replicates_sql(source: str, n_iterations: int) -> str:
    """Rows-mode replicate weights: md5 per (key, block of 4), a 32-bit slice per replicate."""
    u = "(('0x' || substr(h, 8 * j + 1, 8))::bigint / 4294967296.0)"
    weight = "case " + " ".join(f"when {u} < cast({cut!r} as double) then {k}" for k, cut in enumerate(POISSON)) + " else 12 end"
    blocks = (n_iterations + 3) // 4
    return f"""blk as (select *, md5('42:' || cast(encounter_id as varchar) || ':' || cast(b as varchar)) as h
        from (select *, unnest(range(0, {blocks})) as b from {source})),
reps as (select * exclude (h, b, j), 4 * b + j as replicate,
           {weight} as w
         from (select *, unnest(range(0, 4)) as j from blk)),
repw as (select * from reps where w > 0 and replicate < {n_iterations})"""


# D1 with the weighted Brier metric: the same replicate weights, the metric per (group, replicate)
# only when both classes are present, then exact percentiles.
ORACLE["custom_metric_udaf"] = CLEAN_COHORT + f""",
ag as (select encounter_id, score, label, case age {_AGE_CASE} end as age_group from cohort
       where (case age {_AGE_CASE} end) is not null),
{_replicates_sql("ag", 1000)},
per as (select age_group, replicate,
          case when count(distinct label) = 2 then sum(w * power(score - label, 2)) / sum(w) end as value
        from repw group by age_group, replicate)
select age_group, count(value) as replicates, round(quantile_cont(value, 0.025), 9) as ci_low,
  round(quantile_cont(value, 0.975), 9) as ci_high from per group by age_group"""

# The streamed scores equal the batch scores.
ORACLE["stream_scoring"] = ORACLE["scored_batch"]

ORACLE["bootstrap_ci"] = _bootstrap_sql()

# The audit of the test split over four dimensions; a subgroup needs 50 rows, 5 positives and a negative.
ORACLE["audit_ci"] = COHORT_SPLIT + f""",
ts as (select *, case age {_AGE_CASE} end as age_group,
    coalesce(case admission_type_id when 1 then 'Emergency' when 2 then 'Urgent' when 3 then 'Elective' end, 'Other') as admission_type
  from csplit where split = 'test'),
lng as (select encounter_id, score, label, 'race' as dimension, race as subgroup from ts
  union all select encounter_id, score, label, 'gender', case when gender != 'Unknown/Invalid' then gender end from ts
  union all select encounter_id, score, label, 'age_group', age_group from ts
  union all select encounter_id, score, label, 'admission_type', admission_type from ts),
ag as (select * from lng where subgroup is not null),
st as (select dimension, subgroup, count(*) as n, avg(cast(label as double)) as prevalence, avg(score) as mean_pred, sum(label) as positives
       from ag group by all having count(*) >= 50 and sum(label) >= 5 and count(*) > sum(label)),
{_replicates_sql("(select ag.* from ag semi join st using (dimension, subgroup))", 1000)},
{_ranking_sql("repw", "dimension, subgroup, replicate", "w")},
ci as (select dimension, subgroup, count(auroc) as n_ok,
         quantile_cont(auroc, {(1.0 - 0.95) / 2.0!r}) as al, quantile_cont(auroc, {1.0 - (1.0 - 0.95) / 2.0!r}) as ah,
         quantile_cont(auprc, {(1.0 - 0.95) / 2.0!r}) as pl, quantile_cont(auprc, {1.0 - (1.0 - 0.95) / 2.0!r}) as ph
       from rm group by all),
pt as ({_POINT.replace("age_group", "dimension, subgroup")})
select dimension, subgroup, n, round(prevalence, 4) as prevalence, round(mean_pred, 4) as mean_pred,
  round(pt.auroc, 4) as auroc, round(pt.auprc, 4) as auprc,
  case when (1000 - n_ok) / 1000.0 <= 0.1 then cast(round(cast(al as decimal(18,9)), 3) as double) end as auroc_ci_low,
  case when (1000 - n_ok) / 1000.0 <= 0.1 then cast(round(cast(ah as decimal(18,9)), 3) as double) end as auroc_ci_high,
  case when (1000 - n_ok) / 1000.0 <= 0.1 then cast(round(cast(pl as decimal(18,9)), 3) as double) end as auprc_ci_low,
  case when (1000 - n_ok) / 1000.0 <= 0.1 then cast(round(cast(ph as decimal(18,9)), 3) as double) end as auprc_ci_high,
  (select count(*) from ts where gender = 'Unknown/Invalid') as sentinel_rows
from st join pt using (dimension, subgroup) left join ci using (dimension, subgroup)"""


def _bootstrap_ties_sql() -> str:
    return CLEAN_COHORT + f""",
ag as (select encounter_id, floor(score * 10) / 10 as score, label, case age {_AGE_CASE} end as age_group from cohort
       where (case age {_AGE_CASE} end) is not null),
{_replicates_sql("ag", 200)},
{_ranking_sql("repw", "age_group, replicate", "w")},
pt as ({_POINT})
select age_group, cast(replicate as int) as replicate, round(auroc, 9) as auroc, round(auprc, 9) as auprc from rm
union all select age_group, 200, round(auroc, 9), round(auprc, 9) from pt"""


ORACLE["bootstrap_ties"] = _bootstrap_ties_sql()
ORACLE["stream_scoring_once"] = ORACLE["stream_scoring"]

# Values are replaced by their cell's representative (cells grow by 1.01 / 0.99); percentiles are then exact.
ORACLE["stream_band_rollup"] = """
with k as (select ts, value, cast(regexp_extract(props, '"k": ?([0-9]+)', 1) as double) / 100 as p from events where value is not null),
b as (select date_trunc('day', ts) as w, value, case when p < 0.1 then 'low' when p < 0.3 then 'moderate' else 'high' end as risk_band,
        2 * pow(1.01 / 0.99::double, ceil(ln(value) / ln(1.01 / 0.99::double))) / (1.01 / 0.99::double + 1) as rep from k)
select strftime(w, '%Y-%m-%d %H:%M:%S') as window_start, risk_band, count(*) as n, round(avg(value), 6) as mean_value, max(value) as max_value,
  round(quantile_cont(rep, 0.5), 6) as p50, round(quantile_cont(rep, 0.95), 6) as p95, round(quantile_cont(rep, 0.99), 6) as p99
from b group by w, risk_band"""

_CELLS = " union all ".join(f"select encounter_id, '{c}' as col, cast({_q(c) if c != 'medical_specialty' else 'mapped'} as varchar) as category "
                            "from prepared p join mmap on p.medical_specialty = mmap.m" for c in DOMAIN)
ORACLE["wide_one_hot"] = PREPARED + ",\n" + _collapse_sql("prepared") + ",\n" + _vocab_sql("prepared", True, "vocab") + f""",
cells as ({_CELLS})
select p.encounter_id, coalesce(string_agg(cast(position as varchar), ',' order by position), '') as positions
from prepared p left join (select encounter_id, position from cells join vocab using (col, category)) using (encounter_id) group by 1"""

# The same metric over the same replicates, computed from states.
ORACLE["custom_metric_states"] = ORACLE["custom_metric_udaf"]
