"""Queries of the file readers: bytes are put together from table rows in the JVM and read back by the sources.

An order is a track box of its customer's file and its lines are boxes or samples in it. Hex text stands for bytes
until a file is whole. The SQL works the places and values out from the rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import media
from ..operators import catalog
from ..scratch import Scratch
from ..sources import mp4, protobuf, tables
from .queries import query, rnd, table


def be(n: Column, width: int = 4) -> Column:
    """Big-endian hex of a whole number."""
    return F.lpad(F.hex(n), 2 * width, "0")


def once(value: Column, f) -> Column:
    """f(value) with value worked out once, so that nested lengths do not double the expression at each level."""
    return F.transform(F.array(value), f)[0]


def box(typ: str | Column, *body: Column) -> Column:
    """Hex of a box around hex."""
    name = F.hex(F.lit(typ) if isinstance(typ, str) else typ)
    return once(F.concat(F.lit(""), *body), lambda x: F.concat(be(F.length(x) / 2 + 8), name, x))


def joined(df: DataFrame, key: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """key and the values of its rows, joined in order."""
    return df.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, value))), lambda x: x.getField(value)), "").alias(name))


_LINES = "l AS (SELECT o_custkey AS clip, o_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _lines(s, d) -> DataFrame:
    o = table(s, d, "orders").select("o_custkey", "o_orderkey")
    li = table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("long").alias("q"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("clip"), F.col("o_orderkey").alias("k"), "n", "q")


# a file: ftyp (16 bytes), free with a 64-bit size (24), moov at 40 with its tracks, mdat that goes on to the end
_BOXES = f"""WITH {_LINES}, b AS (SELECT *, q + 8 AS size, sum(q + 8) OVER (PARTITION BY clip ORDER BY k, n, q ROWS UNBOUNDED PRECEDING) - q - 8 AS before, dense_rank() OVER (PARTITION BY clip ORDER BY k) AS r FROM l),
t AS (SELECT clip, r, 40 + 8 * r + min(before) AS off, 8 + sum(size) AS size FROM b GROUP BY clip, r),
m AS (SELECT clip, 8 + sum(size) AS size FROM t GROUP BY clip)"""


def _boxes(s, d) -> DataFrame:
    leaf = _lines(s, d).withColumn("leaf", box(F.concat(F.lit("ln"), F.lpad(F.col("n").cast("string"), 2, "0")), F.repeat(F.lit("7A"), F.col("q").cast("int"))))
    trak = joined(leaf, ["clip", "k"], ["n", "q"], "leaf", "inner").select("clip", "k", box("trak", F.col("inner")).alias("trak"))
    free = F.concat(be(F.lit(1)), F.hex(F.lit("free")), be(F.lit(24), 8), be(F.lit(0), 8))
    whole = F.concat(box("ftyp", be(F.lit(0), 8)), free, box("moov", F.col("traks")), be(F.lit(0)), F.hex(F.lit("mdat")), be(F.lit(0), 5))
    files = joined(trak, ["clip"], ["k"], "trak", "traks").select(F.col("clip").cast("string").alias("path"), F.unhex(whole).alias("content"))
    return mp4.read_boxes(files)


@query("mp4_box_walk", f"""{_BOXES}, w AS (SELECT clip, 0 AS depth, -1 AS parent_off, 'ftyp' AS typ, 0 AS off, 16 AS size, 8 AS hdr FROM m UNION ALL SELECT clip, 0, -1, 'free', 16, 24, 16 FROM m UNION ALL SELECT clip, 0, -1, 'moov', 40, size, 8 FROM m UNION ALL SELECT clip, 0, -1, 'mdat', 40 + size, 13, 8 FROM m
UNION ALL SELECT clip, 1, 40, 'trak', off, size, 8 FROM t UNION ALL SELECT clip, 2, t.off, 'ln' || lpad(CAST(n AS VARCHAR), 2, '0'), 48 + 8 * r + before, b.size, 8 FROM b JOIN t USING (clip, r))
SELECT clip, CAST(depth AS INTEGER) AS depth, CAST(parent_off AS BIGINT) AS parent_off, typ, CAST(off AS BIGINT) AS off, CAST(size AS BIGINT) AS size, CAST(hdr AS INTEGER) AS hdr FROM w""")
def _(s, d):
    return _boxes(s, d).select(F.col("path").cast("long").alias("clip"), "depth", F.coalesce("parent_off", F.lit(-1).cast("long")).alias("parent_off"), "typ", "off", "size", "hdr")


@query("mp4_children", f"{_BOXES} SELECT clip, CAST(off AS BIGINT) AS off, CAST(size AS BIGINT) AS size FROM t")
def _(s, d):
    return mp4.children(_boxes(s, d), "moov", "trak").select(F.col("path").cast("long").alias("clip"), "off", "size")


# a customer's file has one track an order: a sample a line, two a chunk, chunk c at 1000 c; codec, widths and versions vary with the key
_TRACKS = f"""WITH {_LINES}, x AS (SELECT *, row_number() OVER (PARTITION BY clip, k ORDER BY n, q) - 1 AS i FROM l),
t AS (SELECT clip, k, dense_rank() OVER (PARTITION BY clip ORDER BY k) - 1 AS trak, CASE WHEN k % 3 = 0 THEN 'avc1' ELSE 'djmd' END AS codec, count(*) AS n, CASE WHEN k % 5 = 0 THEN 9 * count(*) ELSE sum(q) END AS total, CASE WHEN k % 5 = 0 THEN 9 ELSE min(q) FILTER (i = 0) END AS first_size FROM x GROUP BY clip, k)"""


def _tracks(s, d) -> DataFrame:
    k, n = F.col("k"), F.col("n_lines")
    zero, one = be(F.lit(0)), be(F.lit(1))
    per = joined(_lines(s, d).withColumn("hex", be(F.col("q"))), ["clip", "k"], ["n", "q"], "hex", "sizes").withColumn("n_lines", F.length("sizes") / 8)
    offsets = lambda width: F.array_join(F.transform(F.sequence(F.lit(1), F.ceil(n / 2).cast("int")), lambda c: be(c * 1000, width)), "")
    chunks = F.ceil(n / 2)
    stsz = F.when(k % 5 == 0, box("stsz", zero, be(F.lit(9)), be(n))).otherwise(box("stsz", zero, zero, be(n), F.col("sizes")))
    stco = F.when(k % 2 == 0, box("co64", zero, be(chunks), offsets(8))).otherwise(box("stco", zero, be(chunks), offsets(4)))
    stsd = box("stsd", zero, one, box(F.when(k % 3 == 0, "avc1").otherwise("djmd"), be(F.lit(0), 8)))
    stbl = box("stbl", stsd, box("stts", zero, one, be(n), be(F.lit(40))), box("stsc", zero, one, one, be(F.lit(2)), one), stsz, stco)
    mdhd = F.when(k % 4 == 0, box("mdhd", be(F.lit(1), 1), be(F.lit(0), 19), be(k + 25), be(F.lit(0), 12))).otherwise(box("mdhd", be(F.lit(0), 12), be(k + 25), be(F.lit(0), 8)))
    tkhd = box("tkhd", be(F.lit(0), 12), be(k + 1), be(F.lit(0), 8))
    hdlr = box("hdlr", be(F.lit(0), 8), F.hex(F.lit("meta")), be(F.lit(0), 12))
    trak = per.select("clip", "k", box("trak", tkhd, box("mdia", mdhd, hdlr, box("minf", stbl))).alias("trak"))
    files = joined(trak, ["clip"], ["k"], "trak", "traks").select(F.col("clip").cast("string").alias("path"), F.unhex(box("moov", F.col("traks"))).alias("content"))
    return mp4.read_tracks(files)


@query("mp4_tracks", f"""{_TRACKS} SELECT clip, CAST(trak AS INTEGER) AS trak, CAST(k + 1 AS INTEGER) AS track_id, codec, 'meta' AS handler, k + 25 AS timescale, CAST(n AS INTEGER) AS n_samples, CAST(total AS BIGINT) AS total, CAST(ceil(n / 2) AS INTEGER) AS n_chunks, CAST(ceil(n / 2) * 1000 AS BIGINT) AS last_chunk FROM t""")
def _(s, d):
    add = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    return _tracks(s, d).select(F.col("path").cast("long").alias("clip"), "trak", "track_id", "codec", "handler", "timescale", F.size("sizes").alias("n_samples"), add.alias("total"), F.size("chunk_offsets").alias("n_chunks"), F.element_at("chunk_offsets", -1).alias("last_chunk"))


@query("mp4_metadata_track", f"{_TRACKS} SELECT clip, CAST(arg_max(trak, first_size * 1000000 - trak) AS INTEGER) AS trak FROM t WHERE codec = 'djmd' GROUP BY clip")
def _(s, d):
    tracks = Scratch(s, "tracks").table(_tracks(s, d).select("path", "trak", "codec", F.col("sizes")[0].alias("size")), "tracks")
    samples = tracks.select("path", "trak", F.lit(0).alias("sample"), "size")
    return mp4.metadata_track(tracks, samples).select(F.col("path").cast("long").alias("clip"), "trak")


@query("mp4_samples", f"""{_TRACKS} SELECT x.clip, CAST(trak AS INTEGER) AS trak, CAST(i AS BIGINT) AS sample, CAST(i // 2 + 1 AS BIGINT) AS chunk, CAST(CASE WHEN x.k % 5 = 0 THEN 9 ELSE q END AS BIGINT) AS size, CAST(40 * i AS BIGINT) AS pts,
 CAST((i // 2 + 1) * 1000 + CASE WHEN i % 2 = 0 THEN 0 WHEN x.k % 5 = 0 THEN 9 ELSE lag(q) OVER (PARTITION BY x.clip, x.k ORDER BY i) END AS BIGINT) AS off FROM x JOIN t ON x.clip = t.clip AND x.k = t.k""")
def _(s, d):
    got = mp4.expand_samples(_tracks(s, d), ["path", "trak"])
    return got.select(F.col("path").cast("long").alias("clip"), "trak", *(F.col(c).cast("long").alias(c) for c in ("sample", "chunk", "size", "pts", "off")))


# protobuf


def _varint(v: Column) -> Column:
    last = F.ceil(F.length(F.bin(v)) / 7).cast("int") - 1
    return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: be(F.call_function("shiftrightunsigned", v, 7 * i).bitwiseAND(F.lit(127)) + F.when(i < last, 128).otherwise(0), 1)), "")


def _tag(n: int) -> str:
    """Hex of a constant varint of at most two bytes."""
    return f"{n:02X}" if n < 128 else f"{n & 127 | 128:02X}{n >> 7:02X}"


def _field(number: int, wire: int, value: Column) -> Column:
    head = F.lit(_tag(number * 8 + wire))
    if wire == 2:
        return once(value, lambda x: F.concat(head, _varint((F.length(x) / 2).cast("long")), x))
    return F.concat(head, value)


@query("pb_wire_types", """WITH o AS (SELECT o_orderkey AS k, o_orderkey * 1000003 AS v, o_orderpriority AS p FROM orders)
SELECT k, 1 AS field, 0 AS ord, 0 AS wire_type, v AS varint, '' AS raw FROM o UNION ALL SELECT k, 2, 0, 2, -1, hex(p) FROM o UNION ALL SELECT k, 3, 0, 5, -1, lpad(to_hex(k), 8, '0') FROM o
UNION ALL SELECT k, 300, 0, 1, -1, lpad(to_hex(v), 16, '0') FROM o UNION ALL SELECT k, 2, 1, 2, -1, '' FROM o""")
def _(s, d):
    mp4.register(s)
    k, v = F.col("o_orderkey"), F.col("o_orderkey") * 1000003
    # a group (wire type 3) is no field: reading stops there
    raw = F.concat(_field(1, 0, _varint(v)), _field(2, 2, F.hex("o_orderpriority")), _field(3, 5, be(k)), _field(300, 1, be(v, 8)), _field(2, 2, F.lit("")), F.lit("2B"), _field(1, 0, _varint(v)))
    got = s.sql("SELECT k, f.* FROM {m}, LATERAL pb_fields(raw) AS f", m=table(s, d, "orders").select(k.alias("k"), F.unhex(raw).alias("raw")))
    return got.select("k", "field", "ord", "wire_type", F.coalesce(F.col("varint").cast("long"), F.lit(-1).cast("long")).alias("varint"), F.coalesce(F.hex("raw"), F.lit("")).alias("raw"))


#: Little-endian single-precision numbers and their values.
FLOATS = [("0000803F", 1.0), ("0000003F", 0.5), ("000080BF", -1.0), ("00004040", 3.0), ("00000000", 0.0)]
_FLOATS = f"[{', '.join(f'{v}e0' for _, v in FLOATS)}]"


def _float(n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(h) for h, _ in FLOATS)), (n % len(FLOATS) + 1).cast("int"))


def _frames(s, d) -> DataFrame:
    """A frame message an order: every seventh has no frame part, every third no orientation; k % 4 high-rate ones, of which the second is not whole."""
    k = F.col("o_orderkey")
    quad = lambda n, last=4: F.concat(*(_field(c, 5, _float(n + c)) for c in range(1, last + 1)))
    clock = _field(1, 2, _field(2, 0, _varint(k * 40000)))
    state = F.concat(_field(3, 2, _field(1, 5, _float(k))), _field(4, 2, _field(1, 2, F.hex("o_orderpriority"))), _field(6, 2, _field(1, 0, _varint(k + 5000))), F.when(k % 3 == 0, "").otherwise(_field(9, 2, quad(k))), _field(10, 2, quad(k + 1)), _field(16, 2, _field(1, 5, _float(k + 2))))
    rate = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), k % 4), lambda i: F.when(i == 0, "").when(i == 2, _field(3, 2, quad(k + i, 3))).otherwise(_field(3, 2, quad(k + i)))), "")
    part = F.concat(clock, _field(2, 2, state), _field(3, 2, _field(2, 2, _field(1, 2, rate))))
    whole = F.when(k % 7 == 0, _field(1, 0, _varint(k))).otherwise(_field(3, 2, part))
    return protobuf.decode_frames(table(s, d, "orders").select(F.col("o_custkey").alias("clip"), k.alias("k"), F.unhex(whole).alias("payload")))


_FRAMES = f"f AS (SELECT *, {_FLOATS} AS v, o_orderkey AS k FROM orders WHERE o_orderkey % 7 <> 0)"
_AT = "v[(k + {}) % 5 + 1]"


@query("pb_frames", f"""WITH {_FRAMES} SELECT k, k * 40000 AS timestamp, k + 5000 AS color_temp_k, {_AT.format(0)} AS iso, {_AT.format(2)} AS sensor_temp_c, lower(hex(o_orderpriority)) AS shutter, coalesce(CASE WHEN k % 3 <> 0 THEN {_AT.format(1)} END, -9e0) AS qw, coalesce(CASE WHEN k % 3 <> 0 THEN {_AT.format(4)} END, -9e0) AS qz,
 {_AT.format(3)} AS ax, {_AT.format(5)} AS az, CAST(CASE k % 4 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS INTEGER) AS n_rate FROM f""")
def _(s, d):
    none = F.lit(-9.0)
    return _frames(s, d).select("k", "timestamp", F.col("color_temp_K").alias("color_temp_k"), "iso", F.col("sensor_temp_C").alias("sensor_temp_c"), F.col("shutter_raw").alias("shutter"), F.coalesce("qw", none).alias("qw"), F.coalesce("qz", none).alias("qz"), F.col("ax_g").alias("ax"), F.col("az_g").alias("az"), F.size("rate").alias("n_rate"))


@query("pb_high_rate", f"""WITH {_FRAMES}, r AS (SELECT k, v, i, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS subidx FROM f, unnest([1, 3]) AS u(i) WHERE i <= k % 4)
SELECT k, CAST(subidx AS INTEGER) AS subidx, {', '.join(f'v[(k + i + {c}) % 5 + 1] AS q{n}' for c, n in enumerate('wxyz', 1))} FROM r""")
def _(s, d):
    return protobuf.high_rate(_frames(s, d), ["k"])


@query("pb_summary", f"""WITH {_FRAMES}, c AS (SELECT o_custkey AS clip, CASE k % 4 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS n FROM f)
SELECT clip, count(*) AS n_frames, CAST(sum(n) AS BIGINT) AS n_rate, round(sum(n) / CAST(count(*) AS DOUBLE), 6) + 0e0 AS per_frame FROM c GROUP BY clip""")
def _(s, d):
    return protobuf.summary(_frames(s, d), "clip").select("clip", "n_frames", "n_rate", rnd("per_frame").alias("per_frame"))


# text files


# point kinds by event_id % 5: 0 with Z, 1 without zone, 2 at +02:00, 3 with ele and a speed extension, 4 without time
@query("gpx_scan", """WITH e AS (SELECT user_id, event_id AS k, epoch_us(ts) // 1000000 AS sec FROM events WHERE event_id % 5 <> 4)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS ord, sec * 1000000 - CASE WHEN k % 5 = 2 THEN 7200000000 ELSE 0 END AS t_us, round((k % 80) / 1e0, 6) + 0e0 AS lat, round(k % 170 + 0.25e0, 6) + 0e0 AS lon, CASE WHEN k % 5 = 3 THEN k % 900 + 0.5e0 ELSE -1 END AS ele, CASE WHEN k % 5 = 3 THEN k % 30 + 0e0 ELSE -1 END AS speed FROM e""")
def _(s, d):
    k = F.col("event_id")
    time = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 5 == 1, "").when(k % 5 == 2, "+02:00").otherwise("Z"))
    more = F.when(k % 5 == 3, F.concat(F.lit("<ele>"), k % 900, F.lit(".5</ele><extensions><x:a xmlns:x='urn:x'><x:speed>99</x:speed><x:speed> "), k % 30, F.lit(" </x:speed></x:a></extensions>"))).otherwise("")
    point = F.concat(F.lit("<trkpt lat='"), k % 80, F.lit("' lon='"), k % 170, F.lit(".25'>"), F.when(k % 5 == 4, "").otherwise(F.concat(F.lit("<time>"), time, F.lit("</time>"))), more, F.lit("</trkpt>"))
    each = joined(table(s, d, "events").select("user_id", "event_id", point.alias("point")), ["user_id"], ["event_id"], "point", "points")
    body = F.concat(F.lit("<gpx xmlns='urn:g'><trk><trkseg>"), "points", F.lit("</trkseg></trk></gpx>"))
    got = tables.scan_gpx(each.select(F.col("user_id").cast("string").alias("path"), body.cast("binary").alias("content")))
    none = F.lit(-1.0)
    return got.select(F.col("track_id").cast("long").alias("user_id"), F.col("ord").cast("long").alias("ord"), F.unix_micros("t").alias("t_us"), "lat", "lon", F.coalesce("ele", none).alias("ele"), F.coalesce("speed", none).alias("speed"))


@query("media_probe", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 12.5e0 ELSE p_size + 0.5e0 END AS duration_s, CASE p_size % 4 WHEN 0 THEN 25e0 WHEN 1 THEN 30000e0 / 1001e0 ELSE 24e0 END AS fps, p_size * 10 AS width, p_size * 5 AS height,
 CASE WHEN p_size % 2 = 0 THEN 1714564800000000 ELSE -1 END AS created_us, CAST(p_partkey * 7 AS BIGINT) AS size_bytes, p_size % 5 = 0 AS audio, p_size % 5 = 1 AS thumbnail FROM part""")
def _(s, d):
    n = F.col("p_size")
    text = lambda *x: F.concat(*(F.lit(c) if isinstance(c, str) else c.cast("string") for c in x))
    rate = F.when(n % 4 == 0, '"25/1", "avg_frame_rate": "1/1"').when(n % 4 == 1, '"30000/1001"').otherwise('"0/0", "avg_frame_rate": "24"')
    video = text('{"codec_type": "video", "codec_name": "hevc", "width": ', n * 10, ', "height": ', n * 5, ', "duration": "12.5", "r_frame_rate": ', rate, ', "tags": {"creation_time": "', F.when(n % 2 == 0, "2024-05-01T12:00:00Z").otherwise("no time"), '"}}')
    last = F.when(n % 5 == 0, ', {"codec_type": "audio"}').when(n % 5 == 1, ', {"codec_type": "video", "codec_name": "mjpeg"}').otherwise("")
    whole = text('{"streams": [', video, last, '], "format": {"size": "', F.col("p_partkey") * 7, '"', F.when(n % 3 == 0, "").otherwise(text(', "duration": "', n, '.5"')), "}}")
    got = tables.probe(table(s, d, "part").select("p_partkey", whole.alias("probe")))
    return got.select("p_partkey", "duration_s", "fps", "width", "height", F.coalesce(F.unix_micros("creation_time"), F.lit(-1).cast("long")).alias("created_us"), "size_bytes", "audio", "thumbnail")


# rules of names and numbers


@query("path_rules", r"""WITH p AS (SELECT p_partkey, p_size, '/media/' || p_name || ' [' || p_size || '];' || p_brand || ',a:b' AS stem, CASE p_partkey % 6 WHEN 0 THEN '.OSV' WHEN 1 THEN '.mp4' WHEN 2 THEN '.JPeG' WHEN 3 THEN '.gpx' WHEN 4 THEN '.txt' ELSE '' END AS ext FROM part)
SELECT p_partkey, coalesce(CASE p_partkey % 6 WHEN 0 THEN 'osv' WHEN 1 THEN 'mp4' WHEN 2 THEN 'jpg' END, '') AS kind, CASE p_partkey % 6 WHEN 1 THEN 'video/mp4' WHEN 0 THEN 'video/mp4' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'application/gpx+xml' ELSE 'application/octet-stream' END AS media_type,
 CASE WHEN p_partkey % 6 = 0 THEN p_size * 2 ELSE p_size END AS width, replace(replace(replace(replace(replace(stem || ext, ':', '\:'), ',', '\,'), ';', '\;'), '[', '\['), ']', '\]') AS escaped, replace(url_encode(stem || ext), '%2F', '/') AS quoted FROM p""")
def _(s, d):
    ext = F.element_at(F.array(*map(F.lit, [".OSV", ".mp4", ".JPeG", ".gpx", ".txt", ""])), (F.col("p_partkey") % 6 + 1).cast("int"))
    path = F.concat(F.lit("/media/"), "p_name", F.lit(" ["), "p_size", F.lit("];"), "p_brand", F.lit(",a:b"), ext)
    got = table(s, d, "part").select("p_partkey", "p_size", path.alias("path"))
    p = F.col("path")
    return got.select("p_partkey", F.coalesce(media.source_kind(p), F.lit("")).alias("kind"), media.media_type(p).alias("media_type"), media.default_width(p, F.col("p_size")).alias("width"), media.escape_filter_path(p).alias("escaped"), media.url_quote(p).alias("quoted"))


@query("number_rules", """WITH p AS (SELECT *, p_partkey % 5 AS k, round_even(p_size * 100 * tan(radians(least(150e0, greatest(10e0, p_size * 4e0))) / 2) / pi(), 0) AS h FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN p_size / 4e0 WHEN 1 THEN p_size + 0e0 ELSE 0e0 END AS rational, CAST(CASE WHEN h % 2 <> 0 THEN h + 1 ELSE h END AS BIGINT) AS cylinder_height, p_size || ':' || CASE k WHEN 0 THEN '2.5' WHEN 1 THEN '2.25' ELSE CAST(CAST(k AS INTEGER) AS VARCHAR) END AS ratio FROM p""")
def _(s, d):
    n, k = F.col("p_size"), F.col("p_partkey") % 5
    text = F.when(k == 0, F.concat(n, F.lit("/4"))).when(k == 1, n.cast("string")).when(k == 2, F.concat(n, F.lit("/0"))).when(k == 3, "none")
    return table(s, d, "part").select("p_partkey", media.rational(text).alias("rational"), media.cylinder_height(n * 100, n * 4.0).alias("cylinder_height"), media.ratio_text(n.cast("double"), F.when(k == 0, 2.5).when(k == 1, 2.25).otherwise(k.cast("double"))).alias("ratio"))


@query("out_time", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size * 3600 + 62.5e0 WHEN 1 THEN p_size / 1e6 WHEN 2 THEN 0e0 WHEN 3 THEN p_size / 1e6 ELSE -1e0 END AS out_s FROM part""")
def _(s, d):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    clock = F.concat(n, F.lit(":01:02.5"))
    kv = F.when(k == 0, F.create_map(F.lit("out_time"), clock)).when(k == 1, F.create_map(F.lit("out_time_us"), n, F.lit("out_time"), clock)).when(k == 2, F.create_map(F.lit("out_time_us"), F.lit("-5")))
    kv = kv.when(k == 3, F.create_map(F.lit("out_time_us"), F.lit("N/A"), F.lit("out_time_ms"), n)).otherwise(F.create_map(F.lit("out_time"), F.lit("N/A")))
    return table(s, d, "part").select("p_partkey", F.coalesce(media.out_time_s(kv), F.lit(-1.0)).alias("out_s"))


@query("jobs_active", "WITH j AS (SELECT user_id, arg_max(event_type, event_id) AS e FROM events GROUP BY 1) SELECT count(*) FILTER (e IN ('view', 'click')) AS n_active, coalesce(bool_or(e IN ('view', 'click')), false) AS any_active FROM j")
def _(s, d):
    state = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "queued").otherwise("done")
    return catalog.active(catalog.latest(table(s, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), state.alias("status"))))
