"""Listings, shortcut roots, job plans and job states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.media import cache_key, escape_filter_path, extension_in, inside, source_kind, url_quote


def browse(entries: DataFrame, extensions: str | None = None) -> DataFrame:
    """Entries (path, name, is_dir) without hidden ones; files only by extension; folders first, then by name whatever its case."""
    kept = entries.where(~F.col("name").startswith(".") & (F.col("is_dir") | extension_in(F.col("name"), extensions)))
    return kept.orderBy(F.desc("is_dir"), F.lower("name"), "name")


def allowed(entries: DataFrame, roots: list[str]) -> DataFrame:
    return entries.where(inside(F.col("path"), F.array(*map(F.lit, roots))))


def first_by(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """One row a key, the first in the given order: shortcut roots by real path, best metadata track."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def tree(files: DataFrame) -> DataFrame:
    """dir, parent (null above the top), name, path, is_dir of all that lies in any folder: folders are those of the files' paths."""
    parts = F.split(F.regexp_replace("path", "^/+|/+$", ""), "/+")
    each = files.select(parts.alias("p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"))
    folder = lambda n: F.concat(F.lit("/"), F.array_join(F.slice("p", F.lit(1), n), "/"))
    k = F.col("k")
    rows = each.select(folder(k - 1).alias("dir"), F.when(k > 1, folder(F.greatest(k - 2, F.lit(0)))).alias("parent"), F.element_at("p", k).alias("name"), folder(k).alias("path"), (k < F.size("p")).alias("is_dir"))
    return rows.where("name <> ''").distinct()


def listing(index: DataFrame, folder: str, root: str, extensions: str | None = None) -> DataFrame:
    """One folder of tree() as browse() shows it, with its parent; a root has none."""
    own = index.where(F.col("dir") == folder).withColumn("parent", F.lit(None).cast("string") if folder == root else F.col("parent"))
    return browse(own, extensions)


def shortcuts(sources: list[DataFrame], index: DataFrame) -> DataFrame:
    """label, path, kind of all sources (label, path, kind, ord) in their order, each path once, folders of tree() only."""
    ranked = [x.select("label", "path", "kind", F.struct(F.lit(i).alias("source"), F.col("ord").cast("long").alias("ord")).alias("_o")) for i, x in enumerate(sources)]
    every = ranked[0]
    for x in ranked[1:]:
        every = every.unionByName(x)
    first = every.groupBy("path").agg(F.min_by(F.struct("label", "kind"), "_o").alias("s"))
    return first.join(index.where("is_dir").select("path").distinct(), "path", "left_semi").select("s.label", "path", "s.kind")


def selected(entries: DataFrame, selection: DataFrame) -> DataFrame:
    """The entries whose path is in the selection (path)."""
    return entries.join(selection.select("path"), "path", "left_semi")


def first_present(values: Column, *names: str) -> Column:
    """The value of the first of these names that a map has, null values included as in a document."""
    out = F.lit(None)
    for n in reversed(names):
        out = F.when(F.map_contains_key(values, F.lit(n)), F.try_element_at(values, F.lit(n))).otherwise(out)
    return out


def error_tail(lines: DataFrame, key: str = "job", n_lines: int = 40, n_chars: int = 800) -> DataFrame:
    """key, tail: the end of each key's last lines (seq, line), joined by line feeds; a limit on ranks drops the rest before its sort."""
    w = Window.partitionBy(key).orderBy(F.desc("seq"))
    last = lines.select(key, "seq", "line").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n_lines)
    got = last.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("_l"))
    text = F.btrim(F.array_join(F.transform("_l", lambda x: F.concat(x["line"], F.lit("\n"))), ""), F.lit(" \n\t\r"))
    return got.select(key, F.right(text, F.lit(n_chars)).alias("tail"))


def removable(roots: DataFrame) -> DataFrame:
    """Camera mounts by their folder's name."""
    return roots.where(F.col("name").startswith("mtp:") | F.col("name").startswith("gphoto2:"))


#: Options that a job takes over.
OPTIONS = ["out_w", "codec", "encoder", "quality", "interp", "mode", "fps_out", "stabilize", "stabilize_mode", "stabilize_strength"]


def plan_jobs(inputs: DataFrame, options: dict[str, str], street_view: bool = False) -> DataFrame:
    """One queued job an input: id, input, options (known keys with values), status. Street View sets its own rate and tracks."""
    chosen = {k: v for k, v in options.items() if k in OPTIONS and v is not None}
    if street_view:
        chosen = {"codec": "hevc", "quality": "20"} | chosen | {"fps_out": "5", "stabilize": "false", "embed_camm": "true"}
    pairs = [x for k, v in sorted(chosen.items()) for x in (F.lit(k), F.lit(str(v)))]
    made = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return inputs.select(F.sha1("path").alias("id"), F.col("path").alias("input"), made.alias("options"), F.lit("queued").alias("status"))


def resolve_mode(mode: Column, has_maps: Column) -> Column:
    """auto is calibrated where there are maps, else v360; calibrated without maps has no plan."""
    return F.when(mode == "auto", F.when(has_maps, "calibrated").otherwise("v360")).when((mode == "calibrated") & ~has_maps, F.lit(None)).otherwise(mode)


# The argument lists of encoder() and conversion_plan(), which the encoding program must find as they are.


def encoder(codec: Column, wanted: Column, has_hardware: Column, quality: Column) -> tuple[Column, Column, Column]:
    """(encoder, pixel format, arguments) by codec, wish and hardware; auto takes the hardware that is there."""
    hardware = (wanted == "nvenc") | (wanted == "auto") & has_hardware
    h264 = codec == "h264"
    name = F.when(hardware, F.when(h264, "h264_nvenc").otherwise("hevc_nvenc")).otherwise(F.when(h264, "libx264").otherwise("libx265"))
    q = quality.cast("string")
    words = lambda *x: F.array(*(F.lit(w) if isinstance(w, str) else w for w in x))
    args = F.when(hardware, words("-c:v", name, "-rc", "vbr", "-cq", q, "-b:v", "0", "-preset", "p5")).otherwise(words("-c:v", name, "-crf", q, "-preset", "medium"))
    return name, F.when(h264, "yuv420p").otherwise("yuv420p10le"), F.when(h264, args).otherwise(F.concat(args, words("-tag:v", "hvc1")))


def conversion_plan(jobs: DataFrame) -> DataFrame:
    """input, mode, encoder, pix_fmt, argv of each conversion, as data; argv is null where the mode has no plan.

    jobs: input, output, out_w, codec, wanted, has_hardware, quality, interp, mode, has_maps, fps_out (null: the
    source's), commands (path of a command script, null: no stabilisation) and maps (paths: x and y of both lenses, mask).
    """
    name, pix, args = encoder(F.col("codec"), F.col("wanted"), F.col("has_hardware"), F.col("quality"))
    got = jobs.withColumns({"_mode": resolve_mode(F.col("mode"), F.col("has_maps")), "_enc": name, "_pix": pix, "_args": args, "_h": F.floor(F.col("out_w") / 2).cast("int"), "_interp": F.when(F.col("interp").isin("lanczos", "line"), F.col("interp")).otherwise("lanczos")})
    rate = F.when(F.col("fps_out").isNotNull(), F.concat(F.lit("fps="), F.regexp_replace(F.col("fps_out").cast("string"), r"\.0$", ""), F.lit(","))).otherwise("")
    script = F.when(F.col("commands").isNotNull(), F.concat(F.lit("sendcmd=f="), escape_filter_path(F.col("commands")), F.lit(","))).otherwise("")
    start = F.when(F.col("commands").isNotNull(), "yaw=0:pitch=0:roll=0").otherwise("yaw=90")
    size = F.format_string("w=%d:h=%d:interp=%s", "out_w", "_h", "_interp")
    single = F.concat(F.lit("[0:0][0:1]hstack[s];[s]"), rate, script, F.lit("v360=input=dfisheye:output=e:ih_fov=190:iv_fov=190:"), start, F.lit(":"), size, F.lit(",format="), F.col("_pix"), F.lit("[v]"))
    lens = lambda i: F.concat(F.lit(f"[0:{i}]"), rate, F.lit(f"format=gbrp[b{i}];[b{i}][{2 * i + 1}:v][{2 * i + 2}:v]remap=fill=black[e{i}];"))
    turn = F.when(F.col("commands").isNotNull(), F.concat(script, F.lit("v360=e:e:yaw=0:pitch=0:roll=0:"), size, F.lit(","))).otherwise("")
    pair = F.concat(lens(0), lens(1), F.lit("[5:v]format=gbrp[mk];[e0][e1][mk]maskedmerge[mg];[mg]"), turn, F.lit("format="), F.col("_pix"), F.lit("[v]"))
    calibrated = F.col("_mode") == "calibrated"
    inputs = F.when(calibrated, F.flatten(F.transform("maps", lambda m: F.array(F.lit("-i"), m)))).otherwise(F.array().cast("array<string>"))
    words = lambda *x: F.array(*(F.lit(w) if isinstance(w, str) else w for w in x))
    argv = F.concat(words("ffmpeg", "-hide_banner", "-y", "-i", F.col("input")), inputs, words("-filter_complex", F.when(calibrated, pair).otherwise(single), "-map", "[v]", "-map", "0:a?", "-c:a", "copy"), F.col("_args"), words("-progress", "pipe:1", "-nostats", F.col("output")))
    return got.select("input", F.col("_mode").alias("mode"), F.col("_enc").alias("encoder"), F.col("_pix").alias("pix_fmt"), F.when(F.col("_mode").isNotNull(), argv).alias("argv"))


#: The arguments of the two proxies that browsers can play, before and after the input and the graph.
PREVIEW = ["-vf", "scale=1920:960", "-c:v", "libx264", "-pix_fmt", "yuv420p", "-crf", "23", "-preset", "veryfast", "-c:a", "aac", "-movflags", "+faststart", "-progress", "pipe:1", "-nostats", "-f", "mp4"]
NAVIGATION = ["-filter_complex", "[0:0][0:1]hstack[s];[s]v360=input=dfisheye:output=e:ih_fov=190:iv_fov=190:yaw=90:w=688:h=344:interp=line,format=yuv420p[v]", "-map", "[v]", "-an", "-c:v", "libx264", "-preset", "ultrafast", "-crf", "26", "-movflags", "+faststart", "-f", "mp4"]


def proxies(files: DataFrame, cached: DataFrame, folder: str) -> DataFrame:
    """path, kind, target, url, argv of the proxy of each finished output (preview) and camera file (navigation).

    files: path, mtime (text as in the key; null counts as 0), finished. cached: path of proxies that are there. argv is null
    where the target is there already; it writes beside the target, from where a finished file is moved. Files that
    share path and mtime share one proxy; other files have no row.
    """
    mtime = F.coalesce("mtime", F.lit("0"))
    kinds = F.array(
        F.when(F.col("finished"), F.struct(F.lit("preview").alias("kind"), F.concat(F.lit(f"{folder}/previews/"), cache_key(F.col("path"), mtime), F.lit(".mp4")).alias("target"))),
        F.when(source_kind(F.col("path")) == "osv", F.struct(F.lit("navigation").alias("kind"), F.concat(F.lit(f"{folder}/"), cache_key(F.col("path"), mtime, F.lit("navproxy")), F.lit("_nav.mp4")).alias("target"))),
    )
    each = files.select("path", F.explode(kinds).alias("p")).where("p IS NOT NULL").select("path", "p.*").distinct()
    there = cached.select(F.col("path").alias("target")).distinct().withColumn("_there", F.lit(True))
    words = lambda x: F.array(*map(F.lit, x))
    own = F.when(F.col("kind") == "preview", words(PREVIEW)).otherwise(words(NAVIGATION))
    argv = F.concat(words(["ffmpeg", "-y", "-v", "error", "-i"]), F.array("path"), own, F.array(F.concat("target", F.lit(".part"))))
    url = F.concat(F.lit("/api/media?path="), url_quote(F.col("target")))
    return each.join(there, "target", "left").select("path", "kind", "target", url.alias("url"), F.when(F.col("_there").isNull(), argv).alias("argv"))


def latest(events: DataFrame, key: str = "job", order: str = "seq") -> DataFrame:
    """The last state of each job of an append-only log, combined before the shuffle."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_s")).select(key, "_s.*")


def active(states: DataFrame) -> DataFrame:
    """n_active, any_active."""
    busy = F.col("status").isin("queued", "running")
    return states.agg(F.count_if(busy).alias("n_active"), F.coalesce(F.bool_or(busy), F.lit(False)).alias("any_active"))
