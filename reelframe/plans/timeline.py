"""Time bases and timelines over events, line items and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.errors import CONCEAL, SKIP
from reelframe.functions import timebase as T
from reelframe.operators import packets as P
from reelframe.operators import seek, timeline
from reelframe.plans.catalog import QUERIES, SQL, query, table

TYPES = ("click", "error", "purchase", "signup", "view")
# Fixed choice: a time base for each event type.
BASES = ((1, 1000), (1, 48000), (1, 90000), (1001, 30000), (1, 44100))
EPOCH = 1704067200_000000  # 2024-01-01 in microseconds
#: Rows of a stretch of time in the queries that order few streams by many tasks.
STRETCH_ROWS = 250_000


def micros(column: str = "ts"):
    """Microseconds since the epoch of the data, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'2024-01-01 00:00:00'"), F.col(column))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets: a stream an event type, each with its own time base; every seventh has no dts."""
    stream = F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")).cast("int") - 1
    num, den = (F.get(F.array(*[F.lit(b[i]) for b in BASES]), stream) for i in (0, 1))
    tick = F.call_function("div", micros() * den, num * F.lit(1_000_000).cast("long"))
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("path"), stream.alias("stream_index"), F.col("event_id").alias("seq"), tick.alias("pts"),
        F.when(F.col("event_id") % 7 != 0, tick).alias("dts"), (F.col("event_id") % 50).alias("duration"), T.rational(num, den).alias("time_base"),
        F.col("user_id"), F.col("value"), F.col("event_type"), F.col("ts"),
    )


_STREAM = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"
_NUM = "CASE event_type WHEN 'signup' THEN 1001 ELSE 1 END"
_DEN = "CASE event_type WHEN 'click' THEN 1000 WHEN 'error' THEN 48000 WHEN 'purchase' THEN 90000 WHEN 'signup' THEN 30000 ELSE 44100 END"
_PACKETS = f"""p AS (SELECT event_id AS seq, {_STREAM} AS stream_index, ({_NUM})::HUGEINT AS num, ({_DEN})::HUGEINT AS den, event_type, user_id, value, ts,
  ((epoch_us(ts) - {EPOCH})::HUGEINT * ({_DEN})) // (({_NUM})::HUGEINT * 1000000) AS pts,
  CASE WHEN event_id % 7 <> 0 THEN ((epoch_us(ts) - {EPOCH})::HUGEINT * ({_DEN})) // (({_NUM})::HUGEINT * 1000000) END AS dts, event_id % 50 AS duration FROM events)"""


def _round(v: str, src: str, dst: str, how: str) -> str:
    product, sign = f"(abs(({v})::HUGEINT) * abs(({src})::HUGEINT))", f"(CASE WHEN ({v} < 0) <> (({src} < 0) <> ({dst} < 0)) THEN -1 ELSE 1 END)"
    rest = f"({product} % abs(({dst})::HUGEINT))"
    more = {"zero": "FALSE", "inf": f"{rest} > 0", "down": f"{sign} < 0 AND {rest} > 0", "up": f"{sign} > 0 AND {rest} > 0", "near": f"{rest} * 2 >= abs(({dst})::HUGEINT)"}[how]
    return f"({sign} * ({product} // abs(({dst})::HUGEINT) + CASE WHEN {more} THEN 1 ELSE 0 END))::BIGINT"


@query(f"""WITH t AS (SELECT {_STREAM} AS stream_index, event_id, epoch_us(ts) - {EPOCH} AS us FROM events),
k AS (SELECT *, {_round('us', '90000', '1000000', 'near')} AS dts FROM t),
d AS (SELECT *, dts - lag(dts) OVER w AS duration, abs(us / 1000000.0 - lag(us) OVER w / 1000000.0) > 3600 AS gap FROM k WINDOW w AS (PARTITION BY stream_index ORDER BY us, event_id))
SELECT stream_index, count(*)::BIGINT AS packets, sum(duration)::BIGINT AS duration, count(*) FILTER (gap)::BIGINT AS discontinuities FROM d GROUP BY stream_index""")
def stream_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: exact 90 kHz timestamps, durations between packets and gaps over an hour, by stream."""
    rows = packets(spark, sf_dir).select("stream_index", "seq", micros().alias("us"))
    rows = rows.withColumn("dts", T.rescale_q(F.col("us"), T.rational(1, 1_000_000), T.rational(1, 90_000)))
    # five streams, so each is ordered in stretches that follow the number of rows
    rows = timeline.with_previous(timeline.even_spans(rows, "us", STRETCH_ROWS), ["stream_index"], ["us", "seq"], F.col("span"), ["us", "dts"])
    tb = T.rational(1, 1_000_000)
    gap = T.discontinuity(F.col("us"), tb, F.col("__before.us"), tb, 3600.0)
    rows = rows.select("stream_index", (F.col("dts") - F.col("__before.dts")).alias("duration"), gap.alias("discontinuity"))
    return rows.groupBy("stream_index").agg(F.count("*").alias("packets"), F.sum("duration").alias("duration"), F.count_if("discontinuity").alias("discontinuities"))


@query("""SELECT l_orderkey, l_linenumber, (l_partkey // gcd(l_partkey, l_suppkey + 1))::INT AS num, ((l_suppkey + 1) // gcd(l_partkey, l_suppkey + 1))::INT AS den FROM lineitem""")
def rational_reduce(spark, sf_dir):
    r = T.reduce(T.rational(F.col("l_partkey"), F.col("l_suppkey") + 1))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r["num"].alias("num"), r["den"].alias("den"))


_SHOWN = lambda n, d: f"(({n}) // gcd({n}, {d}) * sign({d})::BIGINT)::BIGINT || '/' || (abs({d}) // gcd({n}, {d}))::BIGINT"


@query(f"""WITH r AS (SELECT p_partkey, p_size::BIGINT AS an, 25::BIGINT AS ad, p_partkey % 97 + 1 AS bn, 7::BIGINT AS bd FROM part)
SELECT p_partkey, {_SHOWN('an * bd + bn * ad', 'ad * bd')} AS total, {_SHOWN('an * bd - bn * ad', 'ad * bd')} AS difference, {_SHOWN('an * bn', 'ad * bd')} AS product, {_SHOWN('an * bd', 'ad * bn')} AS quotient FROM r""")
def rational_arith(spark, sf_dir):
    a, b = T.rational(F.col("p_size"), 25), T.rational(F.col("p_partkey") % 97 + 1, 7)
    return table(spark, sf_dir, "part").select("p_partkey", T.show(T.add(a, b)).alias("total"), T.show(T.subtract(a, b)).alias("difference"), T.show(T.multiply(a, b)).alias("product"), T.show(T.divide(a, b)).alias("quotient"))


@query("""WITH r AS (SELECT p_partkey, p_size::BIGINT AS an, p_partkey % 13 - 6 AS ad, p_partkey % 7 AS bn, 3::BIGINT AS bd FROM part)
SELECT p_partkey, CASE WHEN ad <> 0 THEN (sign(an * bd - bn * ad) * sign(ad))::INT END AS ordering, CASE WHEN ad <> 0 THEN an * bd = bn * ad END AS same FROM r""")
def rational_compare(spark, sf_dir):
    a, b = T.rational(F.col("p_size"), F.col("p_partkey") % 13 - 6), T.rational(F.col("p_partkey") % 7, 3)
    return table(spark, sf_dir, "part").select("p_partkey", T.compare(a, b).alias("ordering"), T.equals(a, b).alias("same"))


@query("""SELECT p_partkey, (p_size // gcd(p_size, p_partkey % 50 + 1))::INT AS num, ((p_partkey % 50 + 1) // gcd(p_size, p_partkey % 50 + 1))::INT AS den FROM part""")
def rational_from_double(spark, sf_dir):
    r = T.from_double(F.col("p_size") / (F.col("p_partkey") % 50 + 1), F.lit(1000))
    return table(spark, sf_dir, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.num", "r.den")


def _rescale(how: str):
    def run(spark, sf_dir):
        v = micros() * F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
        return table(spark, sf_dir, "events").select("event_id", T.rescale(v, 90_000, 1_000_000, how).alias("ticks"))

    run.__name__ = f"rescale_{how}"
    return run


for _how in T.ROUNDINGS:
    query(f"""WITH e AS (SELECT event_id, (epoch_us(ts) - {EPOCH}) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS v FROM events)
SELECT event_id, {_round('v', '90000', '1000000', _how)} AS ticks FROM e""")(_rescale(_how))


@query(f"""WITH {_PACKETS} SELECT seq, {_round('pts', 'num * 90000', 'den', 'near')} AS pts, {_round('dts', 'num * 90000', 'den', 'near')} AS dts, {_round('duration', 'num * 90000', 'den', 'near')} AS duration FROM p""")
def rescale_packets(spark, sf_dir):
    return P.rescale_packets(packets(spark, sf_dir), T.rational(1, 90_000)).select("seq", "pts", "dts", "duration")


@query(f"""WITH {_PACKETS}, q AS (SELECT seq, pts, num, den, lag(pts) OVER w AS b, lag(num) OVER w AS bn, lag(den) OVER w AS bd FROM p WINDOW w AS (ORDER BY seq))
SELECT seq, sign(pts * num * bd - b * bn * den)::INT AS ordering FROM q""")
def compare_ts(spark, sf_dir):
    # the packet before by number is met by an equality join: numbers are consecutive
    p = packets(spark, sf_dir).select("seq", "pts", "time_base")
    before = p.select((F.col("seq") + 1).alias("seq"), F.col("pts").alias("b"), F.col("time_base").alias("tb_b"))
    return p.join(before, "seq", "left").select("seq", T.compare_ts(F.col("pts"), F.col("time_base"), F.col("b"), F.col("tb_b")).alias("ordering"))


@query(f"""WITH {_PACKETS} SELECT seq, pts::DOUBLE * (num::DOUBLE / den::DOUBLE) AS seconds,
round((pts * (num::DOUBLE / den::DOUBLE)) / (1.0::DOUBLE / 1000.0::DOUBLE))::BIGINT AS millis FROM p""")
def timestamp_seconds(spark, sf_dir):
    s = T.to_seconds(F.col("pts"), F.col("time_base"))
    return packets(spark, sf_dir).select("seq", s.alias("seconds"), T.from_seconds(s, T.rational(1, 1000)).alias("millis"))


@query(f"""WITH {_PACKETS}, d AS (SELECT seq, abs(pts * (num::DOUBLE / den::DOUBLE) - lag(pts) OVER w * (num::DOUBLE / den::DOUBLE)) > 60 AS discontinuity FROM p WINDOW w AS (PARTITION BY stream_index ORDER BY ts, seq))
SELECT seq, discontinuity FROM d""")
def discontinuity(spark, sf_dir):
    rows = timeline.even_spans(packets(spark, sf_dir).withColumn("us", micros()), "us", STRETCH_ROWS)
    rows = timeline.mark_discontinuities(rows, ["path", "stream_index"], ["ts", "seq"], "pts", "time_base", 60.0, span=F.col("span"))
    return rows.select("seq", "discontinuity")


_LINE = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


def _samples(spark, sf_dir) -> DataFrame:
    """Line items as samples of their order."""
    w = Window.partitionBy("l_orderkey").orderBy(*_LINE.split(", "))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("track"), F.row_number().over(w).cast("long").alias("sample_no"), F.col("l_partkey").alias("size"), F.col("l_quantity").cast("long").alias("duration"), (F.col("l_returnflag") == "R").alias("is_sync"))


_SAMPLES = f"s AS (SELECT l_orderkey AS track, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) AS sample_no, l_partkey AS size, l_quantity::BIGINT AS duration, l_returnflag = 'R' AS is_sync FROM lineitem)"


@query(f"""WITH {_SAMPLES} SELECT track, sample_no, coalesce(sum(duration) OVER (PARTITION BY track ORDER BY sample_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pts FROM s""")
def packet_pts(spark, sf_dir):
    return timeline.running_start(_samples(spark, sf_dir), ["track"], ["sample_no"], "duration", "pts").select("track", "sample_no", "pts")


@query(f"""WITH {_PACKETS}, k AS (SELECT seq, user_id, coalesce(dts, pts) * num * 1000000 AS scaled, den FROM p)
SELECT seq, user_id, row_number() OVER (PARTITION BY user_id ORDER BY (scaled * 2 + den) // (den * 2), scaled // den, (scaled % den)::DOUBLE / den::DOUBLE, seq) AS place FROM k""")
def interleave_dts(spark, sf_dir):
    rows = packets(spark, sf_dir)
    return timeline.interleave(rows, ["path", "user_id"], "seq").select("seq", "user_id", F.col("place").cast("long").alias("place"))


@query("SELECT event_id AS seq, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events")
def interleave_passthrough(spark, sf_dir):
    rows = packets(spark, sf_dir)
    return timeline.interleave(rows, ["path", "user_id"], "seq", by_time=False).select("seq", "user_id", F.col("place").cast("long").alias("place"))


#: Rows of a stretch in the queries that order one stream by many tasks.
ROWS_A_STRETCH = 2_500


@query(f"""WITH {_SAMPLES}, n AS (SELECT *, row_number() OVER (ORDER BY track, sample_no) AS place FROM s)
SELECT track, sample_no, coalesce(sum(duration) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pts FROM n""")
def packet_pts_stretches(spark, sf_dir):
    """All tracks one after another as one stream, which no task orders as a whole."""
    rows = timeline.even_spans(_samples(spark, sf_dir), "track", ROWS_A_STRETCH)
    one = rows.withColumn("stream", F.lit(0))
    return timeline.running_start(one, ["stream"], ["track", "sample_no"], "duration", "pts", F.col("span")).select("track", "sample_no", "pts")


@query(f"""WITH {_PACKETS}, k AS (SELECT seq, coalesce(dts, pts) * num * 1000000 AS scaled, den FROM p)
SELECT seq, row_number() OVER (ORDER BY (scaled * 2 + den) // (den * 2), scaled // den, (scaled % den)::DOUBLE / den::DOUBLE, seq) AS place FROM k""")
def interleave_stretches(spark, sf_dir):
    """All packets into one file, ordered by many tasks."""
    rows = timeline.interleave(packets(spark, sf_dir), ["path"], "seq", rows_per_span=ROWS_A_STRETCH)
    return rows.select("seq", F.col("place").cast("long").alias("place"))


def _index(spark, sf_dir) -> DataFrame:
    """Events as a seek index of their user; views are keyframes, sizes add up to positions."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id"), F.col("event_id").alias("seq"), micros().alias("timestamp"), (F.col("event_id") % 500 + 1).alias("size"), (F.col("event_type") == "view").alias("keyframe"))
    return timeline.running_start(rows, ["user_id"], ["seq"], "size", "pos")


_INDEX = f"""i AS (SELECT user_id, event_id AS seq, epoch_us(ts) - {EPOCH} AS timestamp, event_id % 500 + 1 AS size, event_type = 'view' AS keyframe,
  coalesce(sum(event_id % 500 + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM events)"""
_TARGETS = "t AS (SELECT u.user_id, o.o_orderkey AS target_id, (o.o_orderkey * 7919 % 2592000) * 1000000 AS timestamp FROM orders o JOIN (SELECT DISTINCT user_id FROM events) u ON o.o_custkey % 100 = u.user_id)"


def _targets(spark, sf_dir) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("user_id"), F.col("o_orderkey").alias("target_id"), (F.col("o_orderkey") * 7919 % 2592000 * 1_000_000).alias("timestamp"))
    return orders.join(users, "user_id", "left_semi")


@query(f"""WITH {_INDEX}, {_TARGETS}, f AS (SELECT user_id, min(struct_pack(ts := timestamp, seq := seq)) AS first FROM i GROUP BY user_id)
SELECT t.user_id, t.target_id, coalesce((SELECT max(struct_pack(ts := timestamp, seq := seq)) FROM i WHERE i.user_id = t.user_id AND i.timestamp <= t.timestamp), f.first).seq AS seq FROM t JOIN f ON f.user_id = t.user_id""")
def seek_any(spark, sf_dir):
    return seek.find(_targets(spark, sf_dir), _index(spark, sf_dir), ["user_id"]).select("user_id", "target_id", "entry.seq")


@query(f"""WITH {_INDEX}, {_TARGETS}, f AS (SELECT user_id, min(struct_pack(ts := timestamp, seq := seq, k := keyframe)) AS first FROM i GROUP BY user_id)
SELECT t.user_id, t.target_id, coalesce((SELECT max(struct_pack(ts := timestamp, seq := seq)) FROM i WHERE i.user_id = t.user_id AND i.timestamp <= t.timestamp AND keyframe).seq,
  CASE WHEN t.timestamp < f.first.ts AND f.first.k THEN f.first.seq END) AS seq FROM t JOIN f ON f.user_id = t.user_id""")
def seek_keyframe(spark, sf_dir):
    return seek.find(_targets(spark, sf_dir), _index(spark, sf_dir), ["user_id"], keyframe_only=True).select("user_id", "target_id", "entry.seq")


@query(f"""WITH {_INDEX}, t AS (SELECT user_id, event_id AS target_id, event_id * 13 % 20000 - 50 AS pos FROM events)
SELECT t.user_id, t.target_id, (SELECT max(i.seq) FROM i WHERE i.user_id = t.user_id AND i.pos <= t.pos) AS seq FROM t""")
def seek_bytepos(spark, sf_dir):
    targets = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("target_id"), (F.col("event_id") * 13 % 20000 - 50).alias("pos"))
    return seek.find_by_pos(targets, _index(spark, sf_dir), ["user_id"]).select("user_id", "target_id", "entry.seq")


def _ticks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") / 3 % 2).cast("long").alias("delta"))


_RUNS = """d AS (SELECT user_id, event_id, floor(event_id / 3.0 % 2)::BIGINT AS delta FROM events),
b AS (SELECT *, CASE WHEN delta = lag(delta) OVER w THEN 0 ELSE 1 END AS fresh FROM d WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM b),
runs AS (SELECT user_id, run::BIGINT AS run, count(*)::BIGINT AS count, min(delta) AS delta FROM g GROUP BY user_id, run)"""


@query(f"WITH {_RUNS} SELECT * FROM runs")
def stts_encode(spark, sf_dir):
    return timeline.run_lengths(_ticks(spark, sf_dir), ["user_id"], ["event_id"], "delta")


@query(f"WITH {_RUNS} SELECT * FROM runs")
def run_length_stretches(spark, sf_dir):
    """`stts_encode` with the runs of each stretch found apart and neighbours joined."""
    ticks = timeline.even_spans(_ticks(spark, sf_dir), "event_id", ROWS_A_STRETCH)
    return timeline.run_lengths(ticks, ["user_id"], ["event_id"], "delta", F.col("span")).select("user_id", "run", "count", "delta")


@query(f"""WITH {_RUNS}, n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sample_no, delta FROM d),
last AS (SELECT user_id, max(sample_no) AS m, arg_max(delta, sample_no) AS delta FROM n GROUP BY user_id)
SELECT user_id, sample_no, delta FROM n UNION ALL SELECT user_id, m + k, delta FROM last, (SELECT unnest(range(1, 4)) AS k)""")
def stts_expand(spark, sf_dir):
    ticks = _ticks(spark, sf_dir)
    runs = timeline.run_lengths(ticks, ["user_id"], ["event_id"], "delta")
    totals = ticks.groupBy("user_id").agg((F.count("*") + 3).alias("total"))
    return timeline.expand_runs(runs, ["user_id"], "delta", totals)


def _placed(spark, sf_dir) -> DataFrame:
    """Two samples a chunk in the first two chunks, three after; a chunk of an order lies at 10,000 times its number."""
    samples = _samples(spark, sf_dir)
    totals = samples.groupBy("track").agg(F.count("*").alias("n"))
    chunks = totals.select("track", F.explode(F.expr("sequence(1L, n)")).alias("chunk")).withColumn("offset", F.col("chunk") * 10_000)
    runs = totals.select("track", F.explode(F.array(F.struct(F.lit(1).alias("first_chunk"), F.lit(2).alias("per_chunk")), F.struct(F.lit(3).alias("first_chunk"), F.lit(3).alias("per_chunk")))).alias("r")).select("track", "r.*")
    sync = samples.where("is_sync").select("track", "sample_no")
    return timeline.sample_table(chunks, runs, samples.drop("is_sync"), ["track"], sync)


_PLACED = f"""{_SAMPLES}, c AS (SELECT *, CASE WHEN sample_no <= 4 THEN (sample_no + 1) // 2 ELSE (sample_no - 5) // 3 + 3 END AS chunk FROM s),
o AS (SELECT *, chunk * 10000 + coalesce(sum(size) OVER (PARTITION BY track, chunk ORDER BY sample_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
  coalesce(sum(duration) OVER (PARTITION BY track ORDER BY sample_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shown, bool_or(is_sync) OVER (PARTITION BY track) AS lists FROM c)"""


@query(f"WITH {_PLACED} SELECT track, sample_no, chunk, off::BIGINT AS \"offset\", shown::BIGINT AS pts, is_sync OR NOT lists AS is_sync FROM o")
def sample_table(spark, sf_dir):
    return _placed(spark, sf_dir).select("track", "sample_no", "chunk", "offset", "pts", "is_sync")


@query(f"WITH {_SAMPLES}, a AS (SELECT *, bool_and(is_sync) OVER (PARTITION BY track) AS every FROM s) SELECT track, sample_no FROM a WHERE is_sync AND NOT every")
def stss_list(spark, sf_dir):
    return timeline.sync_list(_samples(spark, sf_dir), ["track"])


@query(f"WITH {_PLACED} SELECT track, sum(duration)::BIGINT AS duration, count(*)::BIGINT AS nb_frames, sum(size)::BIGINT AS bytes, max(off * 100000) > 4294967295 AS wide_offsets FROM o GROUP BY track")
def track_summary(spark, sf_dir):
    placed = _placed(spark, sf_dir).withColumn("offset", F.col("offset") * 100_000)
    return timeline.track_summary(placed, ["track"])


@query("""WITH a AS (SELECT user_id, event_id, event_id % 700 + 1 AS n, coalesce(sum(event_id % 700 + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM events),
f AS (SELECT *, unnest(range(base // 1024, (base + n - 1) // 1024 + 1)) AS frame_no FROM a)
SELECT user_id, event_id, frame_no, greatest(0, frame_no * 1024 - base)::BIGINT AS first, (least(n, (frame_no + 1) * 1024 - base) - greatest(0, frame_no * 1024 - base))::BIGINT AS count FROM f""")
def fifo_reblock(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 700 + 1).alias("samples"))
    return timeline.reblock(rows, ["user_id"], ["event_id"], "samples", 1024).select("user_id", "event_id", "frame_no", "first", "count")


@query("""WITH a AS (SELECT event_id, event_id % 700 + 1 AS n, coalesce(sum(event_id % 700 + 1) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM events),
f AS (SELECT *, unnest(range(base // 1024, (base + n - 1) // 1024 + 1)) AS frame_no FROM a)
SELECT event_id, frame_no, greatest(0, frame_no * 1024 - base)::BIGINT AS first, (least(n, (frame_no + 1) * 1024 - base) - greatest(0, frame_no * 1024 - base))::BIGINT AS count FROM f""")
def reblock_stretches(spark, sf_dir):
    """All events as one stream of samples, cut into frames by many tasks."""
    rows = table(spark, sf_dir, "events").select(F.lit(0).alias("stream"), "event_id", (F.col("event_id") % 700 + 1).alias("samples"))
    rows = timeline.even_spans(rows, "event_id", ROWS_A_STRETCH)
    return timeline.reblock(rows, ["stream"], ["event_id"], "samples", 1024, F.col("span")).select("event_id", "frame_no", "first", "count")


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 5 <> 0 THEN round(value, 2) END AS value FROM events)
SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM e""")
def conceal_last_good(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 5 != 0, F.round("value", 2)).alias("value"))
    return timeline.conceal(rows, ["user_id"], ["event_id"], ["value"]).select("event_id", "value")


@query("SELECT p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand")
def registry_first_wins(spark, sf_dir):
    return timeline.first_registered(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", ["p_partkey"])


def _transcoded(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Event types as streams of which two exist, with payloads of text; the rest are passed over."""
    p = packets(spark, sf_dir).withColumn("data", F.encode(F.concat("event_type", F.col("seq").cast("string")), "utf-8"))
    streams = spark.createDataFrame([("events", 0, "pcm_s16be"), ("events", 4, "pcm_u8")], "path string, index int, codec_id string")
    return p, streams


@query(f"""WITH {_PACKETS} SELECT stream_index, count(*)::BIGINT AS packets_read, count(*) FILTER (stream_index IN (0, 4))::BIGINT AS packets_written FROM p GROUP BY stream_index""")
def transcode_counts(spark, sf_dir):
    p, streams = _transcoded(spark, sf_dir)
    # packets of no stream stay in the scan: both counts come from one pass
    known = streams.select("path", F.col("index").alias("stream_index"), F.lit(1).alias("known"))
    return p.join(known, ["path", "stream_index"], "left").groupBy("stream_index").agg(F.count("*").alias("packets_read"), F.count("known").alias("packets_written"))


@query(f"""WITH {_PACKETS} SELECT seq, upper(to_hex(encode(event_type || seq))) AS data, CASE stream_index WHEN 0 THEN 'pcm_s16be' ELSE 'pcm_u8' END AS codec_id FROM p WHERE stream_index IN (0, 4)""")
def transcode_identity(spark, sf_dir):
    p, streams = _transcoded(spark, sf_dir)
    return P.transcode(p, streams).select("seq", F.hex("data").alias("data"), "codec_id")


@query(f"WITH {_PACKETS} SELECT seq, stream_index FROM p WHERE stream_index IN (0, 4)")
def known_stream_packets(spark, sf_dir):
    p, streams = _transcoded(spark, sf_dir)
    return P.known_streams(p, streams).select("seq", "stream_index")


@query(f"""WITH {_PACKETS} SELECT seq, CASE WHEN seq % 3 > 0 THEN octet_length(encode(event_type)) ELSE 0 END::INT AS size, seq % 3 = 0 AS is_empty, '' AS reset_data, -1::BIGINT AS reset_pos FROM p""")
def packet_predicates(spark, sf_dir):
    """Size and emptiness of packets, of which every third has no data, and what a reset leaves."""
    p = packets(spark, sf_dir).withColumn("data", F.when(F.col("seq") % 3 > 0, F.encode("event_type", "utf-8"))).withColumn("pos", F.col("seq"))
    sized = p.withColumn("size", P.packet_size(F.col("data")))
    return P.reset_packets(sized).where("pts is null").select("seq", "size", (F.col("size") == 0).alias("is_empty"), F.decode("data", "utf-8").alias("reset_data"), F.col("pos").cast("long").alias("reset_pos"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN (p_partkey % 97 + 1) || '/' || (p_size % 5) END AS inverted FROM part""")
def rational_invert(spark, sf_dir):
    r = T.rational(F.col("p_size") % 5, F.col("p_partkey") % 97 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", T.invert(r, SKIP).alias("i")).select("p_partkey", F.when(F.col("i").isNotNull(), T.show(F.col("i"))).alias("inverted"))


@query(f"""WITH {_PACKETS} SELECT seq, CASE WHEN dts IS NULL THEN 'NOPTS' ELSE printf('%.6fs', dts::DOUBLE * (num::DOUBLE / den::DOUBLE)) END AS shown FROM p""")
def timestamp_show(spark, sf_dir):
    return packets(spark, sf_dir).select("seq", T.show_ts(F.col("dts"), F.col("time_base")).alias("shown"))


@query("SELECT p_partkey, i.name AS codec_id, i.name LIKE 'pcm%' AS decodes FROM part JOIN (SELECT unnest(['pcm_u8', 'pcm_s16le', 'h264', 'pcm_f32be', 'opus', 'vorbis']) AS name, unnest(range(6)) AS n) i ON p_partkey % 6 = i.n")
def codec_support(spark, sf_dir):
    """Which codecs the registry can decode; compressed ones are known and refuse."""
    registry, rows = P.default_registry(), []
    for n, name in enumerate(("pcm_u8", "pcm_s16le", "h264", "pcm_f32be", "opus", "vorbis")):
        try:
            registry.decoder(name)(F.lit(b""))
            rows.append((n, name, True))
        except NotImplementedError:
            rows.append((n, name, False))
    listed = spark.createDataFrame(rows, "n int, codec_id string, decodes boolean")  # a row a registered name
    return table(spark, sf_dir, "part").join(F.broadcast(listed), F.col("p_partkey") % 6 == F.col("n")).select("p_partkey", "codec_id", "decodes")


@query(f"""WITH {_PACKETS} SELECT seq, {_round('pts', 'num * 1000', 'den', 'near')} AS pts, upper(to_hex(encode(event_type))) AS data FROM p WHERE stream_index IN (0, 4)""")
def filter_chain(spark, sf_dir):
    """Three filters in a row: streams that exist, milliseconds, and bytes turned round twice."""
    p, streams = _transcoded(spark, sf_dir)
    swap = lambda rows: rows.withColumn("data", P.pcm_encode(F.col("data"), "pcm_s16be"))
    run = P.chain(lambda rows: P.known_streams(rows, streams), lambda rows: P.rescale_packets(rows, T.rational(1, 1000)), swap, swap)
    return run(p.withColumn("data", F.encode("event_type", "utf-8"))).select("seq", "pts", F.hex("data").alias("data"))


@query("""WITH e AS (SELECT event_id, user_id, round(value, 2) AS value, event_id % 5 = 0 AS bad FROM events)
SELECT 'skip' AS mode, event_id, value FROM e WHERE NOT bad UNION ALL
SELECT 'conceal', event_id, last_value(CASE WHEN NOT bad THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) FROM e""")
def error_policies(spark, sf_dir):
    """Corrupt rows left out, and hidden by what their stream said last."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.round("value", 2).alias("value"))
    both = [timeline.with_policy(rows, F.col("event_id") % 5 == 0, ["user_id"], ["event_id"], ["value"], m).select(F.lit(m).alias("mode"), "event_id", "value") for m in (SKIP, CONCEAL)]
    return both[0].unionByName(both[1])


@query(f"""WITH {_INDEX}, {_TARGETS}, b AS (SELECT user_id, event_id AS target_id, event_id * 13 % 20000 - 50 AS pos FROM events)
SELECT 'byte' AS flag, b.user_id, b.target_id, (SELECT max(i.seq) FROM i WHERE i.user_id = b.user_id AND i.pos <= b.pos) AS seq FROM b UNION ALL
SELECT 'any', t.user_id, t.target_id, coalesce((SELECT max(struct_pack(ts := timestamp, seq := seq)) FROM i WHERE i.user_id = t.user_id AND i.timestamp <= t.timestamp).seq, (SELECT min(struct_pack(ts := timestamp, seq := seq)) FROM i WHERE i.user_id = t.user_id).seq) FROM t""")
def seek_flags(spark, sf_dir):
    index = _index(spark, sf_dir)
    places = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("target_id"), (F.col("event_id") * 13 % 20000 - 50).alias("at"))
    by = {seek.BYTE: places, seek.ANY: _targets(spark, sf_dir).withColumnRenamed("timestamp", "at")}
    found = [seek.seek(t, index, ["user_id"], flag).select(F.lit(flag).alias("flag"), "user_id", "target_id", "entry.seq") for flag, t in by.items()]
    return found[0].unionByName(found[1])
