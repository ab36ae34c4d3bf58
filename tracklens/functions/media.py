"""Scalar rules of media options, byte ranges, progress and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm180(a: Column) -> Column:
    """Degrees in [-180, 180)."""
    return F.pmod(a + 180, F.lit(360.0)) - 180


def even(x: Column) -> Column:
    """Nearest integer (halves to even), the next one if odd."""
    n = F.rint(x).cast("long")
    return F.when(F.pmod(n, F.lit(2)) != 0, n + 1).otherwise(n)


def viewer_angles(yaw: Column, pitch: Column, roll: Column) -> tuple[Column, Column, Column]:
    return norm180(yaw + 180), norm180(pitch), norm180(-roll)


def ratio_parts(ratio: Column) -> tuple[Column, Column]:
    """(a, b) of a preset or of "a:b" with a, b > 0 and 0.2 <= a/b <= 8, else nulls; NaN is no number here."""
    parts = F.split(ratio, ":")
    a, b = (F.get(parts, F.lit(i)).try_cast("double") for i in (0, 1))
    good = (F.size(parts) == 2) & ~F.isnan(a) & ~F.isnan(b) & (a > 0) & (b > 0) & (F.try_divide(a, b) >= 0.2) & (F.try_divide(a, b) <= 8.0)
    return F.when(good, a), F.when(good, b)


def flat_size(out_w: Column, a: Column, b: Column, h_fov_deg: Column) -> tuple[Column, Column, Column]:
    """(width, height, vertical field of view in degrees)."""
    w = even(out_w)
    h = even(w * b / a)
    fov = F.least(F.lit(140.0), F.greatest(F.lit(30.0), h_fov_deg))
    return w, h, F.degrees(2 * F.atan(F.tan(F.radians(fov) / 2) * h / w))


def cylinder_height(w: Column, v_span_deg: Column) -> Column:
    span = F.least(F.lit(150.0), F.greatest(F.lit(10.0), v_span_deg))
    return even(w * F.tan(F.radians(span) / 2) / F.pi())


def jpeg_q(quality: Column) -> Column:
    """Encoder scale 2 (best) to 31 of a quality in percent."""
    return F.least(F.lit(31), F.greatest(F.lit(2), F.rint((100 - quality) * 31 / 100).cast("int")))


def is_equirect(w: Column, h: Column) -> Column:
    return F.coalesce((h != 0) & (F.abs(w / F.nullif(h, F.lit(0)) - 2) <= 0.04), F.lit(False))


def rational(x: Column) -> Column:
    """"num/den" or a number; 0 where it cannot be read."""
    p = F.split(x, "/")
    n = p.getItem(0).try_cast("double")
    d = F.when(F.size(p) > 1, F.get(p, F.lit(1)).try_cast("double")).otherwise(F.lit(1.0))
    return F.coalesce(F.try_divide(n, d), F.lit(0.0))


def speed_factor(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), "x$", "").try_cast("double")


def out_time_s(kv: Column) -> Column:
    """Seconds of output: out_time_us, out_time_ms (in microseconds too), or h:m:s. Only the first two are held at 0."""
    whole = lambda k: F.greatest(F.lit(0.0), F.try_element_at(kv, F.lit(k)).try_cast("long") / 1e6)
    text = F.coalesce(F.try_element_at(kv, F.lit("out_time")), F.try_element_at(kv, F.lit("out_time_str")))
    p = F.split(text, ":")
    clock = F.get(p, F.lit(0)).try_cast("long") * 3600 + F.get(p, F.lit(1)).try_cast("long") * 60 + F.get(p, F.lit(2)).try_cast("double")
    us, ms = F.try_element_at(kv, F.lit("out_time_us")).try_cast("long"), F.try_element_at(kv, F.lit("out_time_ms")).try_cast("long")
    return F.when(us.isNotNull(), whole("out_time_us")).when(ms.isNotNull(), whole("out_time_ms")).when(F.size(p) == 3, clock)


def progress(out_s: Column, duration_s: Column, base: float = 0.0, span: float = 1.0) -> Column:
    done = F.greatest(F.lit(0.0), F.least(F.lit(1.0), out_s / F.nullif(duration_s, F.lit(0.0))))
    return F.when((duration_s > 0) & out_s.isNotNull(), base + done * span).otherwise(F.lit(base))


def eta_s(out_s: Column, duration_s: Column, speed: Column, elapsed_s: Column) -> Column:
    left = F.greatest(F.lit(0.0), duration_s - out_s)
    return F.when((duration_s > 0) & out_s.isNotNull(), F.when(speed > 0, left / speed).when(out_s > 0, elapsed_s * (left / out_s)))


def byte_range(header: Column, size: Column) -> tuple[Column, Column, Column]:
    """(status, first byte, last byte) of a Range header: 200 whole, 206 part, 416 refused."""
    pattern = r"^bytes=(\d*)-(\d*)$"
    a, b = (F.regexp_extract(F.trim(header), pattern, i) for i in (1, 2))
    shape = F.trim(header).rlike(pattern) & ((a != "") | (b != ""))
    tail = a == ""
    first = F.when(tail, F.greatest(F.lit(0).cast("long"), size - b.try_cast("long"))).otherwise(a.try_cast("long"))
    last = F.when(tail | (b == ""), size - 1).otherwise(b.try_cast("long"))
    good = shape & (first <= last) & (first < size)
    status = F.when(header.isNull(), 200).when(good, 206).otherwise(416)
    return status, F.when(header.isNull(), F.lit(0).cast("long")).when(good, first), F.when(header.isNull(), size - 1).when(good, F.least(last, size - 1))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))


def extension_in(name: Column, csv: str | None) -> Column:
    """Extension filter from a comma-separated list (dots optional); no list, no files."""
    wanted = sorted({"." + x.strip().lower().lstrip(".") for x in (csv or "").split(",") if x.strip()})
    return extension(name).isin(wanted) if wanted else F.lit(False)


def inside(path: Column, roots: Column) -> Column:
    """Whether path is one of the roots or below one."""
    return F.exists(roots, lambda r: (path == r) | path.startswith(F.concat(r, F.lit("/"))))


def source_kind(path: Column) -> Column:
    e = extension(path)
    return F.when(e == ".osv", "osv").when(e.isin(".mp4", ".mov", ".m4v"), "mp4").when(e.isin(".jpg", ".jpeg"), "jpg")


def cache_key(*parts: Column) -> Column:
    return F.sha1(F.concat_ws(":", *parts))


def escape_filter_path(path: Column) -> Column:
    return F.regexp_replace(path, r"([\\:,;'\[\]])", r"\\$1")


def default_width(path: Column, width: Column) -> Column:
    """Widest panorama of a source: two fisheye frames side by side for camera files."""
    return F.when(source_kind(path) == "osv", 2 * width).otherwise(width)


def media_type(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin(".osv", ".mp4", ".mov", ".m4v"), "video/mp4").when(e.isin(".jpg", ".jpeg"), "image/jpeg").when(e == ".gpx", "application/gpx+xml").otherwise("application/octet-stream")


def url_quote(path: Column) -> Column:
    """Percent-encoding that leaves slashes and spells a space %20."""
    return F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def format_bytes(n: Column) -> Column:
    """Up to TB, one decimal from KB on; a dash for null."""
    big = lambda power, unit: F.format_string(f"%.1f {unit}", n / float(1024**power))
    return F.when(n.isNull(), "—").when(n < 1024, F.format_string("%d B", n)).when(n < 1024**2, big(1, "KB")).when(n < 1024**3, big(2, "MB")).when(n < 1024**4, big(3, "GB")).otherwise(big(4, "TB"))


def format_duration(s: Column) -> Column:
    """1h02m03s or 2m03s of the nearest second; a dash for null and NaN."""
    n = F.floor(s + 0.5).cast("long")
    h, m, sec = F.floor(n / 3600).cast("long"), F.floor(F.pmod(n, F.lit(3600)) / 60).cast("long"), F.pmod(n, F.lit(60))
    return F.when(s.isNull() | F.isnan(s.cast("double")), "—").when(h > 0, F.format_string("%dh%02dm%02ds", h, m, sec)).otherwise(F.format_string("%dm%02ds", m, sec))


def format_eta(s: Column) -> Column:
    return F.when(s < 0, "—").otherwise(format_duration(s))


def format_date(mtime: Column) -> Column:
    """dd/mm/yyyy hh:mm in the session's time zone; empty for null and 0."""
    return F.when(mtime.isNull() | (mtime == 0), "").otherwise(F.date_format(F.timestamp_seconds(mtime), "dd/MM/yyyy HH:mm"))


def split_name(name: Column) -> tuple[Column, Column]:
    """(base, extension with its dot); hidden names and trailing dots have no extension."""
    e = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return F.substr(name, F.lit(1), F.length(name) - F.length(e)), e


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*/*$", "")


def ratio_text(a: Column, b: Column) -> Column:
    """"a:b" with at most two decimals and no trailing zeros."""
    one = lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.regexp_replace(F.format_string("%.2f", x), r"\.?0+$", ""))
    return F.concat(one(a), F.lit(":"), one(b))


# the viewer's camera, in degrees


def view_fov(fov: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(30.0), fov))


def view_latitude(lat: Column) -> Column:
    return F.least(F.lit(85.0), F.greatest(F.lit(-85.0), lat))


def view_yaw(lon: Column) -> Column:
    """In [-180, 180], both ends kept."""
    y = lon % 360
    return F.when(y > 180, y - 360).when(y < -180, y + 360).otherwise(y)


def other_fov(fov: Column, ratio: Column) -> Column:
    """The field of view across, `ratio` being how much longer that side is."""
    return F.degrees(2 * F.atan(F.tan(F.radians(fov) / 2) * ratio))


def frame_fraction(fov: Column, view: Column) -> Column:
    """Share of a view that a capture frame takes; over 1 it does not fit."""
    return F.tan(F.radians(fov) / 2) / F.tan(F.radians(view) / 2)


def fov_of_fraction(fraction: Column, view: Column) -> Column:
    return F.degrees(2 * F.atan(fraction * F.tan(F.radians(view) / 2)))
