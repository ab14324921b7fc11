"""Registered queries: column profiles, cleaning rules, feature transforms, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from careframe.functions.scalars import age_years
from careframe.operators.clean import Rule, clean
from careframe.operators.engineer import Transform, engineer
from careframe.operators.profile import column_profile
from careframe.operators.validate import short_names, validate
from careframe.plans.adapters import AGES_AS_OF, measures, patients, sql, table
from careframe.plans.cases_reports import AGE

KEY = ["l_orderkey", "l_linenumber"]


def _cleaned(s, f, rules, *shown, log=False, **options):
    rows, actions = clean(measures(s, f), rules, **options)
    if log:
        return actions
    return rows.select(*KEY, *shown)


def _rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _rule(column, kind, action, rule_id=0, **condition):
    return Rule(f"{column} {kind} {action}", column, kind, action, condition, True, rule_id)


def _engineered(s, f, step, *shown):
    return engineer(measures(s, f), [step]).select(*KEY, *shown)


PROFILE_SQL = """
select '{c}' as "column", count(*) as rows, count(*) - count({c}) as nulls, round(avg({c}), 4) as mean,
  round(quantile_cont({c}, 0.5), 4) as median,
  (select {c} from measures where {c} is not null group by 1 order by count(*) desc, 1 limit 1) as mode,
  round(quantile_cont({c}, 0.25), 4) as q25, round(quantile_cont({c}, 0.75), 4) as q75,
  min({c}) as min, max({c}) as max, round(stddev_samp({c}), 4) as std from measures"""
PROFILES = sql("measures", PROFILE_SQL.format(c="x") + " union all " + PROFILE_SQL.format(c="q").strip())

FENCES = """fences as (select quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.75) as q3 from measures)"""
BEYOND = "coalesce(x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1), false)"

SEQUENCE = [
    _rule("q", "missing", "drop", 1), _rule("x", "outlier", "flag", 2), _rule("x", "missing", "fill_mean", 3),
    _rule("flag", "missing", "fill_mode", 4), _rule("nowhere", "missing", "drop", 5), _rule("x", "missing", "flag", 6),
]
SEQUENCE_SQL = """
with kept as (select * from measures where q is not null),
f as (select quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.75) as q3, avg(x) as m,
  (select flag from kept where flag is not null group by 1 order by count(*) desc, 1 limit 1) as top from kept)
select l_orderkey, l_linenumber, round(coalesce(x, m), 2) as x, q, coalesce(flag, top) as flag,
  coalesce(x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1), false) as x_outlier from kept, f"""
LOG_SQL = """
with kept as (select * from measures where q is not null),
f as (select quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.75) as q3 from kept)
select 'q missing drop' as rule, 'drop' as action, (select count(*) from measures where q is null) as affected_rows,
  cast(null as bigint) as original_rows, cast(null as bigint) as final_rows, cast(null as bigint) as dropped_rows
union all select 'x outlier flag', 'flag', (select count(*) from kept, f
  where x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1)), null, null, null
union all select 'x missing fill_mean', 'fill_mean', (select count(*) from kept where x is null), null, null, null
union all select 'flag missing fill_mode', 'fill_mode', (select count(*) from kept where flag is null), null, null, null
union all select 'total', 'summary', null, (select count(*) from measures), (select count(*) from kept),
  (select count(*) from measures where q is null)"""

EDGES = "edges as (select min(x) as lo, max(x) as hi, (max(x) - min(x)) / {n} as step from measures)"


def _binned(source, out, **parameters):
    return Transform(source, "binning", out, parameters)


def _aged(s, f):
    people = short_names(patients(s, f))
    on = F.lit(AGES_AS_OF).cast("date")
    k = F.col("id")
    return people.withColumns({
        "age": F.when(k % 29 != 0, age_years(F.col("date_of_birth"), on) + F.when(k % 13 == 0, 80).otherwise(0)),
        "gender": F.when(k % 31 != 0, F.col("gender")),
        "num_partners_12m": F.when(k % 37 == 0, None).when(k % 23 == 0, -1).otherwise(F.col("num_partners_12m")),
        "condom_use_freq": F.when(k % 17 == 0, F.col("condom_use_freq") + 0.5).otherwise(F.col("condom_use_freq")),
    })


AGED = f"""aged as (select id, case when id % 29 <> 0 then {AGE.format(on=AGES_AS_OF)}
    + case when id % 13 = 0 then 80 else 0 end end as age, case when id % 31 <> 0 then gender end as gender,
  case when id % 37 = 0 then null when id % 23 = 0 then -1 else number_of_partners_12m end as num_partners_12m,
  case when id % 17 = 0 then condom_use_frequency + 5e-1 else condom_use_frequency end as condom_use_freq from patients)"""

ERROR_SQL = """list_filter([case when age is null then 'Missing required field: age' end,
  case when gender is null then 'Missing required field: gender' end,
  case when num_partners_12m is null then 'Missing required field: num_partners_12m' end,
  case when age < 10 or age > 120 then 'Age must be between 10 and 120' end,
  case when num_partners_12m < 0 then 'Number of partners cannot be negative' end,
  case when condom_use_freq < 0 or condom_use_freq > 1 then 'Condom use frequency must be between 0 and 1' end],
  lambda e: e is not null)"""

CASES = {
    "column_profile": (
        lambda s, f: _rounded(column_profile(measures(s, f), ["x", "q"]), 4, "mean", "median", "q25", "q75", "std"),
        PROFILES,
    ),
    # The same profile with the percentiles found by narrowing rather than by the built-in.
    "column_profile_narrowed": (
        lambda s, f: _rounded(column_profile(measures(s, f), ["x", "q"], small=500), 4, "mean", "median", "q25", "q75", "std"),
        PROFILES,
    ),
    "fill_mean": (
        lambda s, f: _rounded(_cleaned(s, f, [_rule("x", "missing", "fill_mean")], "x"), 2, "x"),
        sql("measures", "select l_orderkey, l_linenumber, round(coalesce(x, (select avg(x) from measures)), 2) as x from measures"),
    ),
    "fill_median": (
        lambda s, f: _rounded(_cleaned(s, f, [_rule("x", "missing", "fill_median")], "x"), 2, "x"),
        sql("measures", """select l_orderkey, l_linenumber,
round(coalesce(x, (select quantile_cont(x, 0.5) from measures)), 2) as x from measures"""),
    ),
    "fill_mode": (
        lambda s, f: _cleaned(s, f, [_rule("q", "missing", "fill_mode"), _rule("flag", "missing", "fill_mode")], "q", "flag"),
        sql("measures", """select l_orderkey, l_linenumber,
coalesce(q, (select q from measures where q is not null group by 1 order by count(*) desc, 1 limit 1)) as q,
coalesce(flag, (select flag from measures where flag is not null group by 1 order by count(*) desc, 1 limit 1)) as flag
from measures"""),
    ),
    "drop_missing": (
        lambda s, f: _cleaned(s, f, [_rule("x", "missing", "drop")], "x"),
        sql("measures", "select l_orderkey, l_linenumber, x from measures where x is not null"),
    ),
    "flag_missing": (
        lambda s, f: _cleaned(s, f, [_rule("x", "missing", "flag")], "x"),
        sql("measures", "select l_orderkey, l_linenumber, x from measures"),
    ),
    "flag_outliers": (
        lambda s, f: _cleaned(s, f, [_rule("x", "outlier", "flag")], "x", "x_outlier"),
        sql("measures", f"with {FENCES} select l_orderkey, l_linenumber, x, {BEYOND} as x_outlier from measures, fences"),
    ),
    "flag_outliers_narrowed": (
        lambda s, f: _cleaned(s, f, [_rule("x", "outlier", "flag")], "x", "x_outlier", small=500),
        sql("measures", f"with {FENCES} select l_orderkey, l_linenumber, x, {BEYOND} as x_outlier from measures, fences"),
    ),
    "cleaning_sequence": (
        lambda s, f: _rounded(_cleaned(s, f, SEQUENCE, "x", "q", "flag", "x_outlier"), 2, "x"),
        sql("measures", SEQUENCE_SQL),
    ),
    "cleaning_log": (lambda s, f: _cleaned(s, f, SEQUENCE, log=True), sql("measures", LOG_SQL)),
    "flag_format": (
        lambda s, f: clean(patients(s, f), [_rule("phone", "format", "flag", regex="^07[0-9]{3}$")])[0].select(
            "id", "phone", "phone_invalid"),
        sql("patients", "select id, phone, not regexp_matches(phone, '^07[0-9]{3}$') as phone_invalid from patients"),
    ),
    "drop_format": (
        lambda s, f: clean(patients(s, f), [_rule("phone", "format", "drop", regex="^07[0-9]{3}$")])[0].select("id", "phone"),
        sql("patients", "select id, phone from patients where regexp_matches(phone, '^07[0-9]{3}$')"),
    ),
    "drop_duplicates": (
        lambda s, f: clean(table(s, f, "orders"), [
            _rule("o_custkey", "duplicate", "drop", keys=["o_custkey", "o_orderstatus"], order="o_orderkey")])[0]
        .select("o_orderkey", "o_custkey", "o_orderstatus"),
        """select min(o_orderkey) as o_orderkey, o_custkey, o_orderstatus from orders group by o_custkey, o_orderstatus""",
    ),
    "flag_duplicates": (
        lambda s, f: clean(table(s, f, "lineitem"), [
            _rule("l_orderkey", "duplicate", "flag", keys=["l_orderkey", "l_linenumber"])])[0]
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_orderkey_duplicate"),
        """select l_orderkey, l_linenumber, l_partkey,
count(*) over (partition by l_orderkey, l_linenumber) > 1 as l_orderkey_duplicate from lineitem""",
    ),
    "log_transform": (
        lambda s, f: _rounded(_engineered(s, f, Transform("x", "log", "x_log"), "x_log"), 6, "x_log"),
        sql("measures", "select l_orderkey, l_linenumber, round(case when x is not null then ln(1 + greatest(x, 0)) end, 6) as x_log from measures"),
    ),
    "sqrt_transform": (
        lambda s, f: _rounded(_engineered(s, f, Transform("x", "sqrt", "x_sqrt"), "x_sqrt"), 6, "x_sqrt"),
        sql("measures", "select l_orderkey, l_linenumber, round(case when x is not null then sqrt(greatest(x, 0)) end, 6) as x_sqrt from measures"),
    ),
    "min_max_scale": (
        lambda s, f: _rounded(_engineered(s, f, Transform("x", "scale", "x_scaled"), "x_scaled"), 6, "x_scaled"),
        sql("measures", """select l_orderkey, l_linenumber, round((x - lo) / (hi - lo), 6) as x_scaled
from measures, (select min(x) as lo, max(x) as hi from measures)"""),
    ),
    "standardize": (
        lambda s, f: _rounded(_engineered(s, f, Transform("x", "standardize", "x_z"), "x_z"), 6, "x_z"),
        sql("measures", """select l_orderkey, l_linenumber, round((x - m) / sd, 6) as x_z
from measures, (select avg(x) as m, stddev_samp(x) as sd from measures)"""),
    ),
    "equal_width_bins": (
        lambda s, f: _engineered(s, f, _binned("x", "x_bin", bins=5, labels=["a", "b", "c", "d", "e"]), "x", "x_bin"),
        sql("measures", f"""with {EDGES.format(n=5)} select l_orderkey, l_linenumber, x,
case when x is null then null when x <= lo + step then 'a' when x <= lo + 2 * step then 'b' when x <= lo + 3 * step then 'c'
     when x <= lo + 4 * step then 'd' else 'e' end as x_bin from measures, edges"""),
    ),
    "explicit_bins": (
        lambda s, f: engineer(measures(s, f), [
            _binned("q", "q_bin", bins=[0, 10, 20.5, 40]), _binned("q", "q_code", bins=[0, 10, 20.5, 40], labels=False),
        ]).select(*KEY, "q", "q_bin", "q_code"),
        sql("measures", """select l_orderkey, l_linenumber, q,
case when q > 0 and q <= 10 then '(0.0, 10.0]' when q > 10 and q <= 20.5 then '(10.0, 20.5]'
     when q > 20.5 and q <= 40 then '(20.5, 40.0]' end as q_bin,
case when q > 0 and q <= 10 then 0 when q > 10 and q <= 20.5 then 1 when q > 20.5 and q <= 40 then 2 end as q_code
from measures"""),
    ),
    "chained_transforms": (
        lambda s, f: _rounded(engineer(measures(s, f), [
            Transform("x", "log", "x_log", id=1), Transform("x_log", "scale", "x_log_scaled", id=2),
            Transform("absent", "scale", "nothing", id=3)]).select(*KEY, "x_log_scaled"), 6, "x_log_scaled"),
        sql("measures", """with l as (select *, case when x is not null then ln(1 + greatest(x, 0)) end as v from measures)
select l_orderkey, l_linenumber, round((v - lo) / (hi - lo), 6) as x_log_scaled
from l, (select min(v) as lo, max(v) as hi from l)"""),
    ),
    "domain_features": (
        lambda s, f: engineer(_aged(s, f), []).select("id", "risk_exposure_index", "age_group_encoded"),
        sql("patients", f"""with {AGED} select id, num_partners_12m * (1 - condom_use_freq) as risk_exposure_index,
case when age > 0 and age <= 15 then 0 when age > 15 and age <= 20 then 1 when age > 20 and age <= 25 then 2
     when age > 25 and age <= 30 then 3 when age > 30 and age <= 35 then 4 when age > 35 and age <= 40 then 5
     when age > 40 and age <= 50 then 6 when age > 50 and age <= 100 then 7 end as age_group_encoded from aged"""),
    ),
    "one_hot_transform": (
        lambda s, f: _engineered(s, f, Transform("flag", "onehot", "flag"), "flag_A", "flag_N", "flag_R"),
        sql("measures", """select l_orderkey, l_linenumber, coalesce(cast(flag = 'A' as int), 0) as "flag_A",
coalesce(cast(flag = 'N' as int), 0) as "flag_N", coalesce(cast(flag = 'R' as int), 0) as "flag_R" from measures"""),
    ),
    "interaction_transform": (
        lambda s, f: _engineered(s, f, Transform("x", "interaction", "xq", {"other": "q"}), "xq"),
        sql("measures", "select l_orderkey, l_linenumber, x * q as xq from measures"),
    ),
    "record_validation": (
        lambda s, f: validate(_aged(s, f)).select("id", F.array_join("errors", "; ").alias("errors"),
                                                  F.size("errors").alias("error_count"), "is_valid"),
        sql("patients", f"""with {AGED} select id, array_to_string({ERROR_SQL}, '; ') as errors,
len({ERROR_SQL}) as error_count, len({ERROR_SQL}) = 0 as is_valid from aged"""),
    ),
}
