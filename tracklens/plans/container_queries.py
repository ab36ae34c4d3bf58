"""Queries of the ranged container source and the container sink: files are put together from rows of orders and lineitem,
written by the sink, and read back by byte ranges.

A file holds the orders of the customers of one remainder by 40; each order is a track of as many samples as it has lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..sinks import container
from ..sources import ranged
from .file_queries import be, box
from .queries import query, table

FILES = 40
#: Bytes of a track box besides twelve a sample.
TRAK = 248


def _lines(s, d) -> DataFrame:
    o = table(s, d, "orders").select((F.col("o_custkey") % FILES).alias("clip"), F.col("o_orderkey").alias("k"))
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("long").alias("q"))
    return li.join(o, "k")


def parts(s, d) -> DataFrame:
    """name, part, bytes: ftyp, mdat with all samples, moov with a track an order."""
    lines = _lines(s, d)
    per = lines.groupBy("clip", "k").agg(F.array_sort(F.collect_list(F.struct("n", "q"))).alias("x"), F.sum("q").alias("bytes"))
    # what a file's tracks and media take is known from counts, so each order's bytes are made once
    of = lines.groupBy("clip", "k").agg(F.sum("q").alias("media"), (F.count("*") * 12 + TRAK).alias("moov")).groupBy("clip").agg(F.sum("media").alias("media"), (F.sum("moov") + 8 + 108).alias("n"))
    before = F.sum("bytes").over(Window.partitionBy("clip").orderBy("k")) - F.col("bytes")
    placed = per.withColumn("at", before + 24)
    zero, one, n = be(F.lit(0)), be(F.lit(1)), F.size("x")
    words = lambda f: F.array_join(F.transform("x", f), "")
    start = F.struct(F.lit("").alias("t"), F.col("at").alias("p"))
    chunks = F.aggregate("x", start, lambda a, e: F.struct(F.concat(a["t"], be(a["p"], 8)).alias("t"), (a["p"] + e["q"]).alias("p")), lambda a: a["t"])
    codec = F.when(F.col("k") % 3 == 0, F.hex(F.lit("avc1"))).otherwise(F.hex(F.lit("djmd")))
    handler = F.when(F.col("k") % 3 == 0, F.hex(F.lit("vide"))).otherwise(F.hex(F.lit("meta")))
    sized = lambda typ, size, *body: F.concat(be(size), F.hex(F.lit(typ)), *body)
    fixed = lambda typ, size, *body: sized(typ, F.lit(size), *body)
    stbl = sized("stbl", 12 * n + 128, fixed("stsd", 32, zero, one, be(F.lit(16)), codec, be(F.lit(0), 8)), fixed("stts", 24, zero, one, be(n), be(F.lit(40))), fixed("stsc", 28, zero, one, one, one, one), sized("stsz", 4 * n + 20, zero, zero, be(n), words(lambda e: be(e["q"]))), sized("co64", 8 * n + 16, zero, be(n), chunks))
    mdia = sized("mdia", 12 * n + 208, fixed("mdhd", 32, be(F.lit(0), 12), be(F.lit(25)), be(F.lit(0), 8)), fixed("hdlr", 32, be(F.lit(0), 8), handler, be(F.lit(0), 12)), sized("minf", 12 * n + 136, stbl))
    trak = sized("trak", 12 * n + TRAK, fixed("tkhd", 32, be(F.lit(0), 12), be(F.col("k")), be(F.lit(0), 8)), mdia)
    mvhd = box("mvhd", be(F.lit(0), 12), be(F.lit(1000)), be(F.lit(0), 80), be(F.lit(1_000_000)))
    name = F.format_string("clip-%02d.mp4", "clip").alias("name")
    part = lambda section, order, hex_: F.struct((F.lit(section) * F.lit(1 << 40) + order).cast("long").alias("part"), F.unhex(hex_).alias("bytes"))
    row = lambda df, *made: df.select(name, F.explode(F.array(*made)).alias("r")).select("name", "r.part", "r.bytes")
    head = part(0, F.lit(0), F.concat(box("ftyp", be(F.lit(0), 8)), be(F.col("media") + 8), F.hex(F.lit("mdat"))))
    moov = part(2, F.lit(0), F.concat(be(F.col("n")), F.hex(F.lit("moov")), mvhd))
    media = part(1, F.col("k"), words(lambda e: F.repeat(F.lpad(F.hex(e["n"]), 2, "0"), e["q"].cast("int"))))
    return row(of, head, moov).unionByName(row(placed, media, part(3, F.col("k"), trak)))


def _written(s, d) -> str:
    path = Scratch(s, "containers").path("clips")
    container.write_files(parts(s, d), path)
    return path


def _clip():
    return F.regexp_extract("path", r"clip-(\d+)\.mp4$", 1).cast("long").alias("clip")


_SAMPLES = f"""WITH l AS (SELECT o_custkey % {FILES} AS clip, o_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, q) - 1 AS sample, dense_rank() OVER (PARTITION BY clip ORDER BY k) - 1 AS trak FROM l),
x AS (SELECT *, 24 + sum(q) OVER (PARTITION BY clip ORDER BY k, sample ROWS UNBOUNDED PRECEDING) - q AS off FROM r)"""


@query("mp4_ranged_samples", f"""{_SAMPLES} SELECT clip, CAST(trak AS INTEGER) AS trak, k AS track_id, CASE WHEN k % 3 = 0 THEN 'avc1' ELSE 'djmd' END AS codec, CAST(sample AS BIGINT) AS sample, CAST(off AS BIGINT) AS off, q AS size, CAST(40 * sample AS BIGINT) AS pts, repeat(lpad(to_hex(n), 2, '0'), CAST(q AS INTEGER)) AS payload FROM x""")
def _(s, d):
    """Round trip of sink and source: each file in ranges of 64 KiB, samples with their bytes."""
    got = ranged.read(s, "mp4_samples", _written(s, d), range_bytes=1 << 16, payload=True)
    return got.select(_clip(), "trak", "track_id", "codec", "sample", "off", "size", "pts", F.hex("payload").alias("payload"))


@query("mp4_movie_headers", f"""{_SAMPLES}, v AS (SELECT clip, min(trak) AS trak, min(k) AS k FROM x WHERE k % 3 = 0 GROUP BY clip)
SELECT DISTINCT x.clip, CAST(1000 AS BIGINT) AS timescale, CAST(0 AS BIGINT) AS duration, CAST(1000000 AS BIGINT) AS next_track_id, CAST(v.trak AS INTEGER) AS video_trak, v.k AS video_track_id, CASE WHEN v.k IS NOT NULL THEN 'avc1' END AS entry, CASE WHEN v.k IS NOT NULL THEN true END AS known_entry FROM x LEFT JOIN v USING (clip)""")
def _(s, d):
    """Movie headers and the first video track with its sample entry, from reads of the headers alone."""
    return ranged.read(s, "mp4_headers", _written(s, d)).select(_clip(), "timescale", "duration", "next_track_id", "video_trak", "video_track_id", "entry", "known_entry")


@query("mp4_frame_at", f"""{_SAMPLES}, f AS (SELECT clip, k, off, q, sample FROM x WHERE trak = 0), c AS (SELECT DISTINCT clip, g.i / 2e0 AS t FROM f, unnest(range(0, 20)) AS g(i)),
h AS (SELECT c.clip, c.t, max(sample) AS sample FROM c JOIN f ON f.clip = c.clip AND (40 * sample) / 25e0 <= t GROUP BY ALL)
SELECT h.clip, t, CAST(h.sample AS BIGINT) AS sample, CAST(off AS BIGINT) AS off, q AS size, q AS n_read FROM h JOIN f ON f.clip = h.clip AND f.sample = h.sample""")
def _(s, d):
    """The sample that each file's first track shows at each half second, looked up in the stored index; then its bytes alone."""
    path = _written(s, d)
    index = Scratch(s, "samples").table(ranged.read(s, "mp4_samples", path).drop("payload"), "index")
    wanted = index.select("path").distinct().select("path", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i")).select("path", (F.col("i") / 2).alias("t"))
    got = ranged.payloads_of(ranged.frames_at(index, wanted))
    return got.select(_clip(), "t", "sample", "off", "size", F.length("payload").cast("long").alias("n_read"))


@query("media_chunks", f"""WITH l AS (SELECT o_custkey % {FILES} AS clip, count(DISTINCT o_orderkey) AS tracks, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
z AS (SELECT clip, 24 + q + 8 + 108 + 248 * tracks + 12 * n AS size FROM l)
SELECT clip, c AS chunk, 100 + c * 65536 AS off, least(65536, size - 100 - c * 65536) AS n_bytes FROM z, unnest(range(0, 1000000)) AS g(c) WHERE 100 + c * 65536 < size""")
def _(s, d):
    """All bytes from the hundredth on, in chunks, each read by the range it begins in."""
    got = ranged.read(s, "byte_chunks", _written(s, d), range_bytes=1 << 17, chunk_bytes=1 << 16, first=100)
    return got.select(_clip(), "chunk", "off", F.length("bytes").cast("long").alias("n_bytes"))


_GROWN = f"""{_SAMPLES}, t AS (SELECT clip, k, trak, count(*) AS n, sum(q) AS q, min(off) AS media FROM x GROUP BY ALL),
p AS (SELECT clip, k, trak, n, media, 24 + sum(q) OVER (PARTITION BY clip) + 8 + 108 + sum(248 + 12 * n) OVER (PARTITION BY clip ORDER BY k) - 248 - 12 * n AS off, 248 + 12 * n AS size FROM t)"""


@query("mp4_box_growth", f"""{_GROWN}, g AS (SELECT *, CASE WHEN k % 2 = 0 THEN 32 ELSE 0 END AS more FROM p),
s AS (SELECT clip, k, off, off + sum(more) OVER (PARTITION BY clip ORDER BY k) - more + 100 AS new_off, size, size + more AS new_size FROM g)
SELECT clip, 1 AS depth, CAST(off AS BIGINT) AS off, CAST(new_off AS BIGINT) AS new_off, CAST(size AS BIGINT) AS size, CAST(new_size AS BIGINT) AS new_size FROM s
UNION ALL SELECT clip, 0, CAST(min(off) - 116 AS BIGINT), CAST(min(off) - 116 + 100 AS BIGINT), CAST(sum(size) + 116 AS BIGINT), CAST(sum(size) + 116 + sum(more) AS BIGINT) FROM g GROUP BY clip""")
def _(s, d):
    """moov and its tracks after every second track got 32 bytes more at its end and the file 100 bytes before mdat."""
    boxes = Scratch(s, "boxes").table(ranged.read(s, "mp4_boxes", _written(s, d), levels=2), "boxes")
    own = boxes.where("typ IN ('moov', 'trak')").select("path", "depth", "parent_off", "typ", "off", "size")
    inner = boxes.where("typ = 'trak'").withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("off")))
    keys = _lines(s, d).select("clip", "k").distinct().withColumn("r", F.row_number().over(Window.partitionBy("clip").orderBy("k"))).select(F.format_string("clip-%02d.mp4", "clip").alias("file"), "r", "k")
    even = inner.withColumn("file", F.regexp_extract("path", r"[^/]+$", 0)).join(keys, ["file", "r"]).where("k % 2 = 0")
    inserts = even.select("path", F.col("off").alias("parent_off"), (F.col("off") + F.col("size")).alias("at"), F.lit(32).cast("long").alias("n"))
    front = own.where("typ = 'moov'").select("path", F.lit(None).cast("long").alias("parent_off"), F.lit(16).cast("long").alias("at"), F.lit(100).cast("long").alias("n"))
    return container.grown(own, inserts.unionByName(front)).select(_clip(), "depth", "off", "new_off", "size", "new_size")


@query("camm_mux_round_trip", f"""WITH m AS (SELECT o_custkey % {FILES} AS clip, 24 + CAST(sum(l_quantity) AS BIGINT) AS media FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
e AS (SELECT user_id % {FILES} AS clip, epoch_us(ts) / 1e6 AS epoch, value, event_id, row_number() OVER (PARTITION BY user_id % {FILES} ORDER BY event_id) - 1 AS i FROM events),
t AS (SELECT *, CAST(round_even((i + event_id % 3 / 10e0) * 90000e0, 0) AS BIGINT) AS tick FROM e)
SELECT clip, CAST(i AS BIGINT) AS sample, CAST(media + 8 + 60 * i AS BIGINT) AS off, tick - first(tick) OVER (PARTITION BY clip ORDER BY i) AS pts, round(epoch, 6) + 0e0 AS epoch, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 2 END AS fix_type, round(value, 6) + 0e0 AS lat FROM t JOIN m USING (clip)""")
def _(s, d):
    """A packet track put into each file from rows of events, media copied by range, and read back by range."""
    from ..operators import camm

    source = _written(s, d)
    files = ranged.read(s, "mp4_boxes", source, levels=1).where("typ = 'ftyp'").select("path", F.regexp_extract("path", r"[^/]+$", 0).alias("name"))
    e = table(s, d, "events").select((F.col("user_id") % FILES).alias("track_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("epoch"), "value", "event_id")
    e = e.withColumn("i", F.row_number().over(Window.partitionBy("track_id").orderBy("event_id")) - 1).withColumn("t_rel", F.col("i") + F.col("event_id") % 3 / 10)
    timed = camm.durations(camm.ticks(e))
    zero = [F.lit(0.0).alias(c) for c in ("lon", "alt", "h_acc", "v_acc", "vel_e", "vel_n", "vel_up", "speed_acc")]
    packed = camm.packets(timed.select("track_id", "i", "duration", "epoch", F.when(F.col("event_id") % 2 == 0, 3).otherwise(2).alias("fix_type"), F.col("value").alias("lat"), *zero), "duration")
    named = packed.withColumn("name", F.format_string("clip-%02d.mp4", "track_id"))
    path = Scratch(s, "muxed").path("clips")
    container.write_files(container.muxed(files, named.join(files, "name").select("path", "i", "packet", "duration")), path)
    got = camm.unpack(ranged.read(s, "mp4_samples", path, codec="camm", payload=True), "payload")
    return got.select(_clip(), "sample", "off", "pts", F.round("epoch", 6).alias("epoch"), "fix_type", F.round("lat", 6).alias("lat"))
