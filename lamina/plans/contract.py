"""Queries over the contract tables, each with its SQL twin.

events stand for frames (user: stream, ts: presentation time, value: size), lineitem for packets (order: DTS, quantity:
bytes), orders for base frames, supplier and nation for the stream dimension."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import columns, enums
from lamina.operators import buffering, cadence, framing, pairing, sizes
from lamina.plans import fixtures

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frames: the user is the stream, ts in microseconds the presentation time, value the size."""
    e = table(spark, sf_dir, "events")
    size = F.floor(F.abs("value") * 10).cast("long") + 1
    return e.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("pts"), "event_type", "value", size.alias("size"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as packets; quantity is the number of bytes."""
    return table(spark, sf_dir, "lineitem").withColumn("bytes", F.col("l_quantity").cast("long"))


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


# Cadence


@query("""
with d as (select user_id, abs(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by epoch_us(ts), event_id)) as i from events)
select user_id, count(distinct i) as interval_count, count(distinct i) in (1, 2) as consistent from d where i is not null group by user_id
""")
def pts_interval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cadence.validate(frames(spark, sf_dir), ["user_id"], ["pts", "event_id"], "pts")


@query("""
with d as (select user_id, abs(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by epoch_us(ts), event_id)) // 60000000 as minutes from events)
select user_id, minutes, count(*) as n from d where minutes is not null group by user_id, minutes
""")
def pts_interval_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cadence.intervals(frames(spark, sf_dir), ["user_id"], ["pts", "event_id"], "pts")
    return cadence.histogram(d.withColumn("minutes", F.expr("`interval` div 60000000")), ["user_id"], "minutes")


@query("""
with h as (select l_suppkey, l_quantity::bigint as q, count(*) as n from lineitem group by 1, 2)
select l_suppkey, n, string_agg(q::varchar, ',' order by q) as vals from h group by 1, 2
""")
def inverted_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cadence.inverted_histogram(packets(spark, sf_dir), ["l_suppkey"], "bytes")
    return out.withColumn("vals", F.array_join(F.transform("vals", lambda x: x.cast("string")), ","))


# Order


@query("""
select o_orderkey, coalesce(epoch_us(o_orderdate) <= lag(epoch_us(o_orderdate)) over (partition by o_custkey order by o_orderkey), false) as is_late from orders
""")
def pts_monotonic_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("pts", micros("o_orderdate"))
    return framing.with_monotonic_flag(o, ["o_custkey"], ["o_orderkey"], "pts").select("o_orderkey", "is_late")


@query("""
select event_id, round((epoch_us(ts) - first_value(epoch_us(ts)) over (partition by user_id order by epoch_us(ts), event_id)) * 0.000001::double, 6) as seconds from events
""")
def pts_zero_based(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = framing.zero_based(frames(spark, sf_dir), ["user_id"], ["pts", "event_id"], "pts", 1e-6)
    return out.select("event_id", F.round("seconds", 6).alias("seconds"))


@query("select event_id, row_number() over (partition by user_id order by epoch_us(ts), event_id) - 1 as frame_index from events")
def frame_index_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = framing.with_index(frames(spark, sf_dir), ["user_id"], ["pts", "event_id"])
    return out.select("event_id", F.col("frame_index").cast("long").alias("frame_index"))


@query("""
select o_orderkey, row_number() over (partition by o_custkey order by epoch_us(o_orderdate), o_orderkey) - 1 as presentation_index from orders
""")
def reorder_by_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("pts", micros("o_orderdate"))
    out = framing.in_presentation_order(o, ["o_custkey"], "pts", "o_orderkey")
    return out.select("o_orderkey", F.col("presentation_index").cast("long").alias("presentation_index"))


@query("""
with n as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as r from lineitem),
d as (select l_orderkey, l_linenumber, min(r) as r from n group by 1, 2)
select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as release_index,
row_number() over (partition by l_orderkey order by l_linenumber) <> l_linenumber as blocked from d
""")
def release_in_decode_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).select("l_orderkey", "l_linenumber").distinct().withColumn("decode_index", F.col("l_linenumber") - 1)
    out = framing.in_decode_order(p, ["l_orderkey"], "decode_index")
    return out.select("l_orderkey", "l_linenumber", F.col("release_index").cast("long").alias("release_index"), "blocked")


@query("""
with r as (select event_id, user_id, row_number() over (partition by user_id order by epoch_us(ts), event_id) - 1 as frame_index from events)
select event_id, user_id, frame_index from r where frame_index < 25
""")
def presentation_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = framing.with_index(frames(spark, sf_dir), ["user_id"], ["pts", "event_id"])
    return framing.first_frames(out, 25).select("event_id", "user_id", F.col("frame_index").cast("long").alias("frame_index"))


@query("""
with p as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity::bigint as b,
  coalesce(sum(l_quantity::bigint) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity rows between unbounded preceding and 1 preceding), 0) as o,
  sum(l_quantity::bigint) over (partition by l_orderkey) as t from lineitem),
n as (select l_orderkey, o::bigint as o, coalesce(lead(o) over (partition by l_orderkey order by o), t) - o as length from p)
select l_orderkey, o as nal_offset, length::bigint as length from n
""")
def nal_length_by_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    p = packets(spark, sf_dir)
    p = p.withColumn("nal_offset", F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    p = p.withColumn("total", F.sum("bytes").over(Window.partitionBy("l_orderkey")))
    return framing.with_lengths(p, ["l_orderkey"], "nal_offset", "total").select("l_orderkey", "nal_offset", "length")


@query("""
select event_id, last_value(case when event_type = 'error' then event_id end ignore nulls) over (partition by user_id order by epoch_us(ts), event_id rows between unbounded preceding and current row) as config_id from events
""")
def latest_config_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_type") == "error", F.col("event_id"))
    return framing.carried_forward(frames(spark, sf_dir), ["user_id"], ["pts", "event_id"], value, "config_id").select("event_id", "config_id")


# Sizes


@query("""
with t as (select l_orderkey, sum(l_quantity::bigint)::bigint as total from lineitem group by 1),
e as (select l_orderkey, sum(l_quantity::bigint)::bigint as enh from lineitem where l_linenumber = 1 group by 1)
select t.l_orderkey, total, coalesce(enh, 0) as enh, total - coalesce(enh, 0) as remaining, total < coalesce(enh, 0) as failed from t left join e using (l_orderkey)
""")
def remaining_per_dts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    return sizes.remaining_by_dts(p, p.filter("l_linenumber = 1"), ["l_orderkey"], "bytes", "bytes")


@query("select sum(l_quantity::bigint)::bigint as total, sum(case when l_linenumber = 1 then l_quantity::bigint else 0 end)::bigint as enh, count(*) as n_packets from lineitem")
def total_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    enh = F.sum(F.when(F.col("l_linenumber") == 1, F.col("bytes")).otherwise(0))
    return packets(spark, sf_dir).agg(F.sum("bytes").alias("total"), enh.alias("enh"), F.count("*").alias("n_packets"))


@query("select l_suppkey, count(*) as n_frames, count(distinct l_orderkey) as n_dts from lineitem group by 1")
def frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(spark, sf_dir).groupBy("l_suppkey").agg(F.count("*").alias("n_frames"), F.count_distinct("l_orderkey").alias("n_dts"))


@query("""
select l_suppkey, sum(case when l_linenumber % 3 = 1 then l_quantity::bigint else 0 end)::bigint as level_1_size,
sum(case when l_linenumber % 3 = 2 then l_quantity::bigint else 0 end)::bigint as level_2_size,
sum(case when l_linenumber % 3 = 0 then l_quantity::bigint else 0 end)::bigint as temporal_size from lineitem group by 1
""")
def sublayer_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("l_linenumber") % 3 == 0, 3).otherwise(F.col("l_linenumber") % 3)
    layers = packets(spark, sf_dir).withColumn("sublayer", enums.name_of(enums.SUBLAYER, code))
    return sizes.sublayer_bytes(layers, ["l_suppkey"], "sublayer", "bytes")


@query("""
with t as (select s_nationkey, sum(l_quantity::bigint)::bigint as total, sum(case when l_linenumber = 1 then l_quantity::bigint else 0 end)::bigint as enh,
  sum(case when l_linenumber = 1 then 1 else 0 end)::bigint as n_enh, count(distinct l_orderkey) as n_base from lineitem join supplier on l_suppkey = s_suppkey group by 1)
select n_name, total, enh, total - enh as base_size, round(n_enh / 25.0::double, 6) as enh_seconds, round(enh * 8.0::double / nullif(n_enh / 25.0::double, 0), 6) as enh_bitrate,
round(case when total > enh then (total - enh) * 8.0::double / (n_base / 25.0::double) end, 6) as base_bitrate, round(enh::double / nullif(total - enh, 0), 6) as enh_base_ratio
from t join nation on s_nationkey = n_nationkey
""")
def summary_bitrate_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream dimension is small and bounded; Spark's size check decides whether it is broadcast."""
    is_enh = F.col("l_linenumber") == 1
    p = packets(spark, sf_dir).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    t = p.groupBy("s_nationkey").agg(F.sum("bytes").alias("total"), F.sum(F.when(is_enh, F.col("bytes")).otherwise(0)).alias("enh"), F.count_if(is_enh).alias("n_enh"), F.count_distinct("l_orderkey").alias("n_base"))
    s = sizes.summary(t, F.lit(25.0), F.col("total"), F.col("enh"), F.col("n_enh"), F.col("n_base"))
    named = s.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    rounded = [F.round(c, 6).alias(c) for c in ("enh_seconds", "enh_bitrate", "base_bitrate", "enh_base_ratio")]
    return named.select("n_name", "total", "enh", "base_size", *rounded)


@query("""
with b as (select c_nationkey, c_mktsegment, o_orderkey is not null as b from customer left join orders on c_custkey = o_custkey)
select c_nationkey, c_mktsegment, case when min(b::int) = max(b::int) then max(b::int) = 1 end as has_base, min(b::int) <> max(b::int) as mixed from b group by 1, 2
""")
def base_presence_all_or_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return sizes.base_presence(c, ["c_nationkey", "c_mktsegment"], F.col("o_orderkey").isNotNull())


@query("""
with s as (select l_orderkey % 100 as stream, l_linenumber, l_quantity::bigint as wire, sum(l_quantity::bigint) over (partition by l_orderkey)::bigint as total, (round(l_extendedprice)::bigint % 90) as payload from lineitem)
select stream, sum(case when wire > 20 then wire else payload end)::bigint as enh, sum(total - case when wire > 20 then wire else payload end)::bigint as base, sum(total)::bigint as combined,
sum(case when total < case when wire > 20 then wire else payload end then 1 else 0 end)::bigint as failed from s group by 1
""")
def frame_size_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    p = packets(spark, sf_dir).withColumn("total", F.sum("bytes").over(Window.partitionBy("l_orderkey")))
    payload = F.round("l_extendedprice").cast("long") % 90
    wire = F.when(F.col("bytes") > 20, F.col("bytes"))
    s = p.withColumn("s", sizes.frame_sizes(payload, wire, F.lit(None).cast("long"), F.col("total"), F.lit(True)))
    sums = [F.sum(F.col(f"s.{c}")).alias(c) for c in ("enh", "base", "combined")]
    return s.groupBy((F.col("l_orderkey") % 100).alias("stream")).agg(*sums, F.count_if("s.failed").alias("failed"))


# Joins


@query("""
with l as (select distinct l_orderkey from lineitem)
select coalesce(o_orderkey, l_orderkey) as pts, case when o_orderkey is null then 'enh_only' when l_orderkey is null then 'base_only' else 'matched' end as status from orders full outer join l on o_orderkey = l_orderkey
""")
def pts_join_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    enh = packets(spark, sf_dir).select(F.col("l_orderkey").alias("pts")).distinct()
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pts"))
    return pairing.pair_by_pts(enh, base, ["pts"]).select("pts", "status")


@query("""
with r as (select o_custkey, o_orderkey, epoch_us(o_orderdate) as pts, row_number() over (partition by o_custkey order by epoch_us(o_orderdate), o_orderkey) - 1 as p, row_number() over (partition by o_custkey order by o_orderkey) - 1 as d from orders)
select e.o_orderkey, b.pts as base_pts, e.pts <> b.pts as differs from r e join r b on e.o_custkey = b.o_custkey and e.d = b.p
""")
def decode_index_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", micros("o_orderdate").alias("pts"))
    enh = framing.with_index(o, ["o_custkey"], ["o_orderkey"], "decode_index")
    base = framing.with_index(o, ["o_custkey"], ["pts", "o_orderkey"], "decode_index")
    return pairing.true_pts(enh, base, ["o_custkey", "decode_index"]).select("o_orderkey", "base_pts", "differs")


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def duplicate_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.duplicates(packets(spark, sf_dir), ["l_orderkey", "l_linenumber"])


@query("""
with e as (select o_custkey, count(distinct l_orderkey) as n_enh from lineitem join orders on l_orderkey = o_orderkey group by 1), b as (select o_custkey, count(*) as n_base from orders group by 1)
select coalesce(e.o_custkey, b.o_custkey) as o_custkey, coalesce(n_enh, 0) as n_enh, coalesce(n_base, 0) as n_base, coalesce(n_enh, 0) = coalesce(n_base, 0) as complete from e full outer join b on e.o_custkey = b.o_custkey
""")
def stream_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    enh = base.join(packets(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return pairing.completeness(enh, base, ["o_custkey"])


# Headers and scalars


HASHED = "(p_partkey * 40503 + 12345) % 65536"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sixteen-bit header made of each part's key."""
    return table(spark, sf_dir, "part").withColumn("word", F.expr(HASHED).cast("int"))


@query(f"select p_partkey, w >> 15 as forbidden, (w >> 9) & 63 as nal_type, (w >> 3) & 63 as layer_id, w & 7 as temporal_id_plus1 from (select p_partkey, ({HASHED})::int as w from part)")
def nal_header_hevc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("p_partkey", columns.hevc_header(F.col("word")).alias("h")).select("p_partkey", "h.*")


@query(f"select p_partkey, w >> 15 as forbidden, (w >> 3) & 31 as nal_type, (w >> 8) & 63 as layer_id, w & 7 as temporal_id_plus1 from (select p_partkey, ({HASHED})::int as w from part)")
def nal_header_vvc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("p_partkey", columns.vvc_header(F.col("word")).alias("h")).select("p_partkey", "h.*")


@query(f"select p_partkey, w >> 7 as forbidden, (w >> 5) & 3 as ref_idc, w & 31 as nal_type from (select p_partkey, (({HASHED}) >> 8)::int as w from part)")
def nal_header_h264(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.shiftright("word", 8)
    return words(spark, sf_dir).select("p_partkey", columns.h264_header(first).alias("h")).select("p_partkey", "h.*")


@query(f"select p_partkey, (w >> 14) = 1 and (w & 511) = 511 as valid, (w >> 9) & 31 as nal_type from (select p_partkey, (({HASHED}) | 511)::int as w from part)")
def nal_header_enh(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.col("word").bitwiseOR(511)
    return words(spark, sf_dir).select("p_partkey", columns.enh_header(word).alias("h")).select("p_partkey", "h.*")


def _nal_case(codec: str, top: int) -> str:
    return " ".join(f"when {k} then '{enums.nal_name(codec, k)}'" for k in range(top))


@query(f"select p_partkey, case ({HASHED}) % 32 {_nal_case('H264', 32)} end as h264, case ({HASHED}) % 64 {_nal_case('HEVC', 64)} end as hevc, case ({HASHED}) % 32 {_nal_case('VVC', 32)} end as vvc from part")
def nal_type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = [enums.nal_name_column(c, F.col("word") % top).alias(c.lower()) for c, top in (("H264", 32), ("HEVC", 64), ("VVC", 32))]
    return words(spark, sf_dir).select("p_partkey", *named)


@query("""
with s as (select user_id, event_type, sum(case when value > 50 then 3 else 1 end) as score from events group by 1, 2),
r as (select *, row_number() over (partition by user_id order by score desc, event_type) as r from s)
select user_id, event_type as codec, score::bigint as score from r where r = 1
""")
def codec_score_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    s = frames(spark, sf_dir).groupBy("user_id", "event_type").agg(F.sum(F.when(F.col("value") > 50, 3).otherwise(1)).alias("score"))
    best = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "event_type"))
    return s.withColumn("r", best).filter("r = 1").select("user_id", F.col("event_type").alias("codec"), "score")


@query("""
with s as (select p_partkey, p_size * 97 as w, p_size * 61 as h, ['SCALING_0D', 'SCALING_1D', 'SCALING_2D'][(p_partkey % 3)::int + 1] as m from part),
d as (select p_partkey, w, h, case when m = 'SCALING_0D' then w else (w + 1) // 2 end as w1, case when m = 'SCALING_2D' then (h + 1) // 2 else h end as h1 from s)
select p_partkey, (((w + 511) // 512) * ((h + 255) // 256))::bigint as level2, (((w1 + 511) // 512) * ((h1 + 255) // 256))::bigint as level1 from d
""")
def tile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = enums.name_of(enums.SCALING, (F.col("p_partkey") % 3).cast("int"))
    counts = columns.tile_counts(F.col("p_size") * 97, F.col("p_size") * 61, F.lit(512), F.lit(256), mode)
    return table(spark, sf_dir, "part").select("p_partkey", counts.alias("c")).select("p_partkey", "c.level2", "c.level1")


@query("""
with f as (select p_partkey, case p_partkey % 5 when 0 then 23.976::double when 1 then 29.975::double when 2 then 59.93::double when 3 then 25::double else p_size::double end as f from part)
select p_partkey, round(case when abs(f - 23.976) < 0.01 then 24000 / 1001.0::double when abs(f - 29.97) < 0.01 then 30000 / 1001.0::double when abs(f - 59.94) < 0.01 then 60000 / 1001.0::double else f end, 6) as fps from f
""")
def fps_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("p_partkey") % 5
    fps = F.when(r == 0, 23.976).when(r == 1, 29.975).when(r == 2, 59.93).when(r == 3, 25.0).otherwise(F.col("p_size").cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(columns.normalised_fps(fps), 6).alias("fps"))


@query(
    "with r(i, w, h) as (values " + ", ".join(f"({k}, {w}, {h})" for k, (w, h) in enumerate(enums.RESOLUTIONS, 1)) + ") "
    "select p_partkey, case when p_partkey % 64 = 63 then p_size * 16 else w end as width, case when p_partkey % 64 = 63 then p_size * 9 else h end as height from part left join r on r.i = p_partkey % 64"
)
def resolution_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = (F.col("p_partkey") % 64).cast("int")
    size = columns.resolution(index, F.col("p_size") * 16, F.col("p_size") * 9)
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.width", "s.height")


@query("""
with b as (select o_orderkey, o_orderkey % 128 as b0, (o_orderkey * 7) % 128 as b1, (o_orderkey * 13) % 128 as b2, o_orderkey % 3 as n from orders)
select o_orderkey, (case n when 0 then b0 when 1 then b0 * 128 + b1 else (b0 * 128 + b1) * 128 + b2 end)::bigint as value from b
""")
def vlq_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 3
    parts = [k % 128, (k * 7) % 128, (k * 13) % 128]
    hexed = [F.lpad(F.hex(p + F.when(n > i, 128).otherwise(0)), 2, "0") for i, p in enumerate(parts)]
    data = F.unhex(F.substring(F.concat(*hexed), F.lit(1), (n + 1).cast("int") * 2))
    return table(spark, sf_dir, "orders").select("o_orderkey", columns.varint(data).alias("value"))


# Buffer simulation, in whole numbers: a step a minute, 40 bytes a step


STEP, FILL, CAPACITY = 60_000_000, 40, 5_000
RELEASED_SQL = f"""
f as (select event_id, user_id, epoch_us(ts) as pts, floor(abs(value) * 10)::bigint + 1 as size from events),
z as (select *, row_number() over w - 1 as k, (pts - first_value(pts) over w + {STEP} - 1) // {STEP} as need from f window w as (partition by user_id order by pts, event_id)),
r as (select *, k + max(need - k) over w as release_step, sum(size) over w as gone, max(need) over (partition by user_id) + 1 as n_steps from z window w as (partition by user_id order by pts, event_id rows between unbounded preceding and current row)),
l as (select *, release_step < n_steps as released, (case when release_step < n_steps then release_step * {FILL} - gone end)::bigint as frame_level from r)
"""


def _released(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("pts", "event_id")
    need = F.expr(f"(zero + {STEP - 1}) div {STEP}")
    f = frames(spark, sf_dir).withColumn("zero", F.col("pts") - F.first("pts").over(w)).withColumn("need", need)
    f = f.withColumn("n_steps", F.max("need").over(Window.partitionBy("user_id")) + 1)
    return buffering.released(f, ["user_id"], ["pts", "event_id"], F.col("need"), F.col("size"), F.lit(FILL), F.col("n_steps"))


@query(f"with {RELEASED_SQL} select event_id, release_step::bigint as release_step, released, frame_level from l")
def buffer_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _released(spark, sf_dir).select("event_id", "release_step", "released", "frame_level")


@query(f"with {RELEASED_SQL} select event_id, round(frame_level * 100 / {CAPACITY}.0::double, 6) as fill_percent, case when frame_level < 0 or frame_level > {CAPACITY} then 'X' else '' end as flag from l")
def buffer_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = buffering.with_flags(_released(spark, sf_dir), "frame_level", F.lit(CAPACITY))
    return out.select("event_id", F.round("fill_percent", 6).alias("fill_percent"), "flag")


@query(f"""
with {RELEASED_SQL},
s as (select user_id, unnest(range(0, max(n_steps)::bigint)) as step from l group by user_id),
g as (select user_id, release_step as step, sum(size) as gone from l where released group by 1, 2),
v as (select s.user_id, s.step, s.step * {FILL} - coalesce(sum(coalesce(g.gone, 0)) over (partition by s.user_id order by s.step rows between unbounded preceding and 1 preceding), 0) as level from s left join g on s.user_id = g.user_id and s.step = g.step),
p as (select user_id, step, 0 as kind, level::bigint as level from v union all select user_id, release_step, 1, frame_level from l where frame_level is not null)
select user_id, kind, count(*) as n, min(level)::bigint as lowest, max(level)::bigint as highest, sum(level)::bigint as total, max(step)::bigint as last_step from p group by 1, 2
""")
def buffer_sawtooth_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plot's points, summed up by stream and kind."""
    f = _released(spark, sf_dir)
    runs = f.groupBy("user_id").agg(F.max("n_steps").alias("n_steps"))
    levels = buffering.step_levels(runs, f.filter("released"), ["user_id"], "size", F.lit(FILL))
    p = buffering.sawtooth(levels, f, ["user_id"])
    return p.groupBy("user_id", "kind").agg(F.count("*").alias("n"), F.min("level").alias("lowest"), F.max("level").alias("highest"), F.sum("level").alias("total"), F.max("step").alias("last_step"))


# Streams of bytes. No table holds any, so they are made by an encoder, and SQL tells them as values


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/extracted-{uuid.uuid4().hex}"


def _written(spark: SparkSession, fmt: str) -> DataFrame:
    """The made streams' frames written by a sink and read again as files."""
    from lamina.sources import readers, sinks

    folder = _folder(spark)
    sinks.write_frames(readers.bin_frames(fixtures.files(spark)), folder, fmt).count()
    return readers.files(spark, folder)


def _made(*columns: str) -> str:
    """The made streams' frames as SQL values."""
    frames = [(stream, k, fixtures.frame(k)) for stream, n in fixtures.MADE.items() for k in range(n)]
    rows = ", ".join(f"('{stream}', {k}, {k ^ 1}, {len(d)}, '{d.hex().upper()}')" for stream, k, d in frames)
    return f"select {', '.join(columns)} from (values {rows}) as t(stream, decode_index, pts, wire_size, bytes)"


@query(_made("stream", "decode_index::bigint as decode_index", "pts::bigint as pts", "wire_size::bigint as wire_size", "bytes"))
def bin_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of made BIN files, written by the BIN sink and read again."""
    from lamina.sources import readers

    stream = F.regexp_extract("stream_id", r"([^/]+)-[0-9a-f]{8}\.bin$", 1).alias("stream")
    return readers.bin_frames(_written(spark, "BIN")).select(stream, "decode_index", "pts", "wire_size", F.hex("data").alias("bytes"))


@query()
def block_decode_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoded blocks of a made stream."""
    from lamina.plans import analyze
    from lamina.sources import readers

    return analyze.decode_blocks(readers.bin_frames(fixtures.files(spark)).withColumn("frame_index", F.col("decode_index")))


@query(_made("stream", "decode_index::bigint as decode_index", "bytes"))
def extract_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the raw sink wrote of made streams, a row a frame."""
    from lamina.sources import readers

    stream = F.regexp_extract("stream_id", r"([^/]+)-[0-9a-f]{8}\.lvc$", 1).alias("stream")
    return readers.raw_frames(_written(spark, "RAW")).select(stream, "decode_index", F.hex("data").alias("bytes"))


@query()
def strict_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the exact merge replay: all orders of a customer against those with a line item that came back."""
    o = table(spark, sf_dir, "orders")
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    base = o.select(F.col("o_custkey").cast("string").alias("stream_id"), micros("o_orderdate").alias("pts"), F.col("o_orderkey").alias("id"))
    enh = o.join(returned, "o_orderkey", "left_semi").select(F.col("o_custkey").cast("string").alias("stream_id"), micros("o_orderdate").alias("pts"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("decode_index"))
    return pairing.replayed(enh, base)


@query()
def streaming_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful reorder buffer over the files of orders as a stream, to its end."""
    from lamina.streaming import reorder

    def frames(o: DataFrame) -> DataFrame:
        return o.select(F.col("o_custkey").cast("string").alias("stream_id"), F.col("o_orderkey").alias("decode_index"), micros("o_orderdate").alias("pts"))

    # A stream reads a folder or a pattern; this one stands for a file as well as for a folder of that name.
    return reorder.run_files(spark, f"{sf_dir}/orders.parque[t]", table(spark, sf_dir, "orders").schema, depth=16, frames=frames)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
