"""The ``encounters`` stand-in table built from the driver's ``orders`` and ``customer`` tables.

One order is one encounter and the customer is the patient. The text below is the
test-data specification (FIXTURES.md section 4); it is valid SQL in both Spark and DuckDB,
apart from the quoting of ``A1Cresult`` which is parameterised. ``score`` is a planted-signal
test score (it looks at the label): it exercises the metrics, it is never a model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import cut_lineage

# Fixed test-data specification (FIXTURES.md section 4), kept verbatim.
_ENCOUNTER_CTES = """o as (
  select o.*, c.c_mktsegment,
    lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as nxt,
    count(*) over (partition by o_custkey order by o_orderdate
                   range between interval 365 days preceding and interval 1 day preceding) as prior_n
  from {orders} o join {customer} c on o_custkey = c_custkey),
e as (
select o_orderkey as encounter_id, o_custkey as patient_nbr,
  case c_mktsegment when 'MACHINERY' then 'Caucasian' when 'BUILDING' then 'AfricanAmerican'
    when 'AUTOMOBILE' then 'Hispanic' when 'FURNITURE' then 'Other' end as race,
  case when o_custkey % 50 = 7 then 'Unknown/Invalid' when o_custkey % 2 = 0 then 'Female' else 'Male' end as gender,
  concat('[', cast(((o_custkey * 7) % 10) * 10 as string), '-', cast(((o_custkey * 7) % 10) * 10 + 10 as string), ')') as age,
  cast(substr(o_orderpriority, 1, 1) as int) as admission_type_id,
  case when o_orderkey % 97 = 0 then null else cast(o_orderkey % 28 + 1 as int) end as discharge_disposition_id,
  cast(o_orderkey % 25 + 1 as int) as admission_source_id,
  cast(o_orderkey % 14 + 1 as int) as time_in_hospital,
  case when o_orderkey % 2 = 0 then null when o_orderkey % 211 = 1 then 'Podiatry'
    when o_orderkey % 173 = 3 then 'Dentistry' when o_orderkey % 5 < 2 then 'InternalMedicine'
    when o_orderkey % 5 = 2 then 'Cardiology' else 'Family/GeneralPractice' end as medical_specialty,
  cast((o_orderkey * 13) % 132 as int) as num_lab_procedures,
  cast(o_orderkey % 7 as int) as num_procedures,
  cast((o_orderkey * 17) % 81 as int) as num_medications,
  case when o_orderkey % 11 = 0 then null else cast(prior_n as int) end as number_inpatient,
  cast(o_orderkey % 16 + 1 as int) as number_diagnoses,
  case (o_orderkey * 31) % 12 when 0 then 'V57' when 1 then 'E906' when 2 then '250.83' when 3 then null
    when 4 then '  ' when 5 then ' 428 ' when 6 then 'abc' when 7 then '459.9'
    else concat(cast((o_orderkey * 37) % 1000 as string), '.', cast(o_orderkey % 10 as string)) end as diag_1,
  case o_orderkey % 9 when 0 then '>200' when 1 then '>300' when 2 then 'Norm' end as max_glu_serum,
  case o_orderkey % 7 when 0 then '>7' when 1 then '>8' when 2 then 'Norm' when 3 then 'None' end as {a1c},
  case o_orderkey % 4 when 0 then 'No' when 1 then 'Down' when 2 then 'Steady' else 'Up' end as insulin,
  case when nxt is null then 'NO' when nxt <= o_orderdate + interval 30 days then '<30' else '>30' end as readmitted,
  prior_n, o_orderdate
from o),
encounters as (
select *, cast(least(999, 20 + (encounter_id * 7919 + 104729) % 200 + 30 * prior_n
   + case when readmitted = '<30' then 80 * ((encounter_id * 13) % 3) else 0 end) as double) / 1000 as score from e)"""


def encounters_cte_sql() -> str:
    """DuckDB form: CTE list ending in ``encounters`` (append ``select ... from encounters``)."""
    return "with " + _ENCOUNTER_CTES.format(orders="orders", customer="customer", a1c='"A1Cresult"')


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


BUCKET_DAYS = 90     # a customer's orders are handled in stretches of so many days


def _spec_parts() -> tuple[str, str]:
    """The specification split into the customer-window CTE (``o``) and the rest (``e``, ``encounters``)."""
    cut = _ENCOUNTER_CTES.index("),\ne as (") + 1
    return _ENCOUNTER_CTES[:cut], _ENCOUNTER_CTES[cut + 2:]


def _customer_windows(o: DataFrame) -> DataFrame:
    """``nxt`` and ``prior_n`` of the specification without a window over a whole customer.

    Windows run over (customer, stretch of BUCKET_DAYS days), so a customer holding a third of all
    orders is spread over many tasks; one small row per customer and stretch links the stretches.

    * prior_n (orders of the customer dated within [d - 365 days, d - 1 day]) is an as-of count: orders
      (weight 1) and two probes an order (weight 0), at d - 1 day and just before d - 365 days, are
      counted up by (time, kind) within the stretch, and the totals of earlier stretches added;
      prior_n = count at the late probe - count at the early probe.
    * nxt (the customer's next order by (date, key)) is the next order of the stretch, else the first
      of the customer's next stretch that has one.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    def at(kind: int, when, weight: int):
        return F.struct(F.lit(kind).alias("kind"), when.alias("t"), F.lit(weight).cast("bigint").alias("w"))
    date = F.col("o_orderdate").cast("timestamp_ntz")
    marks = F.array(at(0, date - F.expr("INTERVAL 365 DAYS"), 0), at(1, date, 1), at(2, date - F.expr("INTERVAL 1 DAY"), 0))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    rows = (o.select("o_custkey", "o_orderkey", "o_orderdate", F.inline(marks))
            .withColumn("stretch", F.floor(F.timestamp_diff("SECOND", epoch, F.col("t")) / (86_400 * BUCKET_DAYS)))
            .withColumn("own_date", F.when(F.col("kind") == 1, F.col("o_orderdate"))))
    keys = ["o_custkey", "stretch"]
    upto = Window.partitionBy(*keys).orderBy("t", "kind", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    after = (Window.partitionBy(*keys).orderBy(F.desc("t"), F.desc("kind"), F.desc("o_orderkey"))
             .rowsBetween(Window.unboundedPreceding, -1))
    counted = rows.withColumns({"n_here": F.sum("w").over(upto), "next_here": F.last("own_date", ignorenulls=True).over(after)})
    stretches = rows.groupBy(*keys).agg(F.sum("w").alias("n"), F.min("own_date").alias("head"))
    earlier = Window.partitionBy("o_custkey").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("o_custkey").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    linked = stretches.select(*keys, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
                              F.last("head", ignorenulls=True).over(later).alias("next_head"))
    joined = counted.join(linked, keys)
    count = F.col("n_here") + F.col("n_before")
    found = joined.groupBy("o_orderkey").agg(
        (F.sum(F.when(F.col("kind") == 2, count)) - F.sum(F.when(F.col("kind") == 0, count))).alias("prior_n"),
        F.max(F.when(F.col("kind") == 1, F.coalesce("next_here", "next_head"))).alias("nxt"))
    return o.join(found, "o_orderkey")


#: What the specification reads of an order beside its two window columns.
_READ = ("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "c_mktsegment", "nxt", "prior_n")


def encounters(spark: SparkSession, sf_dir: str, strategy: str = "stretches", keep: bool = False) -> DataFrame:
    """The 26-column encounter table (plus ``prior_n``, ``o_orderdate``, ``score``).

    With ``keep`` the seven columns that the specification reads are checkpointed first: for a caller that goes
    over the table several times (a fit and what follows it), so that the windows are computed once.

    ``stretches`` computes the two per-customer window columns as in :func:`_customer_windows`, at every
    size; ``window`` runs the specification as written (one window a customer) and is there to test against.
    """
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    if strategy == "window":
        sql = _ENCOUNTER_CTES.format(orders="{orders}", customer="{customer}", a1c="A1Cresult")
        return spark.sql("with " + sql + " select * from encounters", orders=orders, customer=customer)
    if strategy != "stretches":
        raise ValueError(f"unknown strategy {strategy}")
    joined = orders.join(customer.select("c_custkey", "c_mktsegment"), orders.o_custkey == customer.c_custkey) \
        .drop("c_custkey")
    _, rest = _spec_parts()
    rest = rest.format(a1c="A1Cresult")
    o = _customer_windows(joined)
    if keep:
        o = cut_lineage(o.select(*_READ))
    return spark.sql("with o as (select * from {o_df}), " + rest + " select * from encounters", o_df=o)
