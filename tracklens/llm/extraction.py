"""Main text of web pages by equivalence classes of tokens over the pages of a host.

A page's tokens are its elements, each named by its path, and its text blocks, named by path and text. A first pass writes
every page's skeleton (token ids and counts, no text). Tokens of one host with the same occurrence vector (how often on
which page, held as two 64-bit sums over pages) form a class; frequent classes, on half of the pages or more, are
candidates. A class is valid if its tokens come in one order on all pages and, page by page, lie within one slot of every
class that is more frequent or larger. The valid classes' elements, nested, are the template; the texts that it
leaves are the slots' contents. A slot is the article's, or not, by what all its pages show: names, links, amount of text. A
second pass over the pages extracts the article's slots.

A host may hold a third of all pages: vectors, checks and slot sums are combined before their shuffles, and what is gathered
for a host is its template, which is no longer than twice its mean page, as each of its tokens is on half of the pages.

Defined cases: null or empty html gives an empty text; a null url, or one without "://", is of the host ""; rows are judged one
by one, equal ones too; a host of one page has that page's elements for a template; where a page's slot is not in the
template, the page's own names decide; an empty table gives no rows; other columns are ignored; a very long page is whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, arrow_schema, map_batches
from .html_tree import Block, Element, parse
from .native import BROADCAST_BYTES, heavy_keys, spread_join

_SKELETON = "host string, page long, ids array<long>, ups array<long>, counts array<int>, words array<int>, linked array<int>, kinds array<int>"
#: Kinds of tokens: bits.
TEXT, MARKED, ARTICLE = 1, 2, 4


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class _Numbers:
    """One a task: numbers its pages."""

    def __init__(self) -> None:
        self.next = TaskContext.get().partitionId() << 32

    def take(self) -> int:
        self.next += 1
        return self.next - 1


def host(url):
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^.*?://([^/?#]*)", 1))


def _tokens(html: str | None) -> list[tuple[int, int, int, int, int, int]]:
    """id, up, count, words, linked, kind of a page's tokens in order of their first place."""
    found: dict[int, list[int]] = {}
    for x in parse(html):
        if isinstance(x, Element):
            row = [_signed(x.id), _signed(x.up.id), 0, 0, 0, MARKED * x.marked + ARTICLE * x.article]
        else:
            row = [_signed(x.id), _signed(x.element.id), 0, x.words, x.linked, TEXT + MARKED * x.element.marked + ARTICLE * x.element.article]
        found.setdefault(row[0], row)[2] += 1
    return [tuple(r) for r in found.values()]


def skeletons(pages: DataFrame, scratch: Scratch) -> DataFrame:
    def make(numbers: _Numbers, hosts: list, html: list) -> dict[str, list]:
        rows = [list(zip(*_tokens(h), strict=True)) or [()] * 6 for h in html]
        cols = {name: [list(r[k]) for r in rows] for k, name in enumerate(("ids", "ups", "counts", "words", "linked", "kinds"))}
        return {"host": hosts, "page": [numbers.take() for _ in html], **cols}

    return scratch.table(map_batches(pages.select("host", "html"), make, _SKELETON, text="html", init=_Numbers), "skeletons")


def candidates(skeleton: DataFrame, scratch: Scratch) -> DataFrame:
    """host, n_pages and its frequent tokens: id, up, kind, class (tokens with one occurrence vector share it), n (pages)."""
    token = F.explode(F.arrays_zip("ids", "ups", "counts", "kinds")).alias("t")
    each = skeleton.select("host", "page", token).select("host", "page", F.col("t.ids").alias("id"), F.col("t.ups").alias("up"), F.col("t.counts").alias("count"), F.col("t.kinds").alias("kind"))
    # page numbers are unique, so a sum modulo 2 tells sets of (page, count) apart as well as one modulo 2^64
    vector = [F.bit_xor(F.xxhash64("page", "count")).alias("v1"), F.bit_xor(F.xxhash64("count", "page", F.lit("v"))).alias("v2")]
    vectors = scratch.table(each.groupBy("host", "id").agg(*vector, F.count("*").alias("n"), F.min("up").alias("up"), F.max("kind").alias("kind")), "vectors")
    hosts = skeleton.groupBy("host").agg(F.count("*").alias("n_pages"))
    heavy = scratch.table(heavy_keys(vectors, ["host"]), "many_tokens")
    frequent = spread_join(vectors, hosts, ["host"], "id", heavy).where(2 * F.col("n") >= F.col("n_pages"))
    of = F.struct("id", "up", "kind", F.xxhash64("v1", "v2", "n").alias("class"), "n")
    return scratch.table(frequent.groupBy("host").agg(F.max("n_pages").alias("n_pages"), F.collect_list(of).alias("tokens")), "candidates")


def _slot(id_: int, up: dict[int, int], template: set[int] | dict[int, int]) -> int:
    """The nearest element around that is in the template; 0 if none."""
    while id_ and id_ not in template:
        id_ = up.get(id_, 0)
    return id_


_CHECK = "host string, what int, key long, order long, ok boolean, words long, linked long, kind int"


def _check(name: str | None, tokens: list[dict], ids: list[int], ups: list[int], words: list[int], linked: list[int], kinds: list[int]):
    """Rows of _CHECK from one page: 0 for each class (its order here, and whether it lies in one slot of every greater
    class), 1 for each slot (its words).
    """
    cls = {t["id"]: t["class"] for t in tokens}
    frequent = {t["class"]: t["n"] for t in tokens}
    here: dict[int, list[int]] = {}
    for at, i in enumerate(ids):
        if i in cls:
            here.setdefault(cls[i], []).append(at)
    greater: list[np.ndarray] = []
    for c in sorted(here, key=lambda c: (-frequent[c], -len(here[c]), c)):
        at = np.array(here[c])
        ok = all(len(set(np.searchsorted(g, at).tolist())) == 1 or len(set(np.searchsorted(at, g).tolist())) == 1 for g in greater)
        greater.append(at)
        yield (name, 0, c, _signed(xxhash.xxh64_intdigest(np.array([ids[k] for k in at]).tobytes())), ok, 0, 0, 0)
    up = {i: u for i, u, k in zip(ids, ups, kinds, strict=True) if not k & TEXT}
    slots = {t["id"] for t in tokens if not t["kind"] & TEXT}
    for i, u, w, n, k in zip(ids, ups, words, linked, kinds, strict=True):
        if k & TEXT and not k & MARKED:
            slot = _slot(u, up, slots)
            free = not (i in cls and frequent[cls[i]] >= 3 or k & ARTICLE)  # what the template itself says is no content
            yield (name, 1, slot, 0, True, w * free, n * free, k)


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """host, elements (of valid classes), texts (template text), main (elements whose slot is the article's). pages: host, html."""
    skeleton = skeletons(pages, scratch)
    found = candidates(skeleton, scratch)
    heavy = scratch.table(heavy_keys(skeleton, ["host"]), "many_pages")
    met = spread_join(skeleton, found.select("host", "tokens"), ["host"], "page", heavy)
    names = [f.split()[0] for f in _CHECK.split(", ")]

    def check(*columns: list) -> dict[str, list] | None:
        rows = [r for page in zip(*columns, strict=True) for r in _check(*page)]
        return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else None

    checks = map_batches(met.select("host", "tokens", "ids", "ups", "words", "linked", "kinds"), check, _CHECK, text="")
    sums = checks.groupBy("host", "what", "key").agg((F.bool_and("ok") & (F.min("order") == F.max("order"))).alias("ok"), F.sum("words").alias("words"), F.sum("linked").alias("linked"), F.max("kind").alias("kind"))
    # at most a row a class and slot of the template
    per_host = sums.groupBy("host").agg(F.collect_list(F.struct("what", "key", "ok", "words", "linked", "kind")).alias("checks"))
    out = "host string, elements array<long>, texts array<long>, main array<long>"

    def decide(hosts: list, tokens: list, checked: list) -> dict[str, list]:
        made = [_decide(t, c or []) for t, c in zip(tokens, checked, strict=True)]
        return {"host": hosts, **{k: [m[n] for m in made] for n, k in enumerate(("elements", "texts", "main"))}}

    return scratch.table(map_batches(found.join(per_host, "host", "left").select("host", "tokens", "checks"), decide, out, text=""), "templates")


def _decide(tokens: list[dict], checks: list[dict]) -> tuple[list[int], list[int], list[int]]:
    """Elements and texts of a host's template, and the elements whose slots are the article's."""
    valid = {c["key"] for c in checks if c["what"] == 0 and c["ok"]}
    elements = {t["id"]: t for t in tokens if t["class"] in valid and not t["kind"] & TEXT}
    texts = [t["id"] for t in tokens if t["class"] in valid and t["kind"] & TEXT and not t["kind"] & ARTICLE and t["n"] >= 3]
    up = {t["id"]: t["up"] for t in tokens if not t["kind"] & TEXT}
    free: dict[int, int] = {}
    named = []
    for c in checks:
        if c["what"] == 1:
            slot = _slot(c["key"], up, elements)
            if slot and elements[slot]["kind"] & ARTICLE:
                named.append(slot)
            elif c["words"] > 2 * c["linked"]:
                free[slot] = free.get(slot, 0) + c["words"] - c["linked"]
    if named or not free:
        return list(elements), texts, sorted(set(named))
    most = max(free, key=lambda s: (free[s], s))
    around, s = set(), up.get(most, 0)
    while s and up.get(up.get(s, 0), 0):  # titles and leads stand beside the longest slot, but not in html or body
        around.add(s)
        s = up.get(s, 0)
    return list(elements), texts, [s for s in free if 4 * free[s] >= free[most] or s in around]


def _alone(html: str | None) -> set[int]:
    """The article's slots of a page that has none of its host's: as if its host had no other page."""
    rows = _tokens(html)
    tokens = [{"id": r[0], "up": r[1], "kind": r[5], "class": 0, "n": 1} for r in rows]
    checks = _check(None, tokens, *(list(c) for n, c in enumerate(zip(*rows, strict=True)) if n != 2))
    return set(_decide(tokens, [dict(zip(("host", "what", "key", "order", "ok", "words", "linked", "kind"), c, strict=True)) for c in checks])[2])


def main_text(html: str | None, elements: set[int], texts: set[int], main: set[int]) -> str:
    """The blocks of the template's article slots and of what the page itself names its article."""
    blocks, up = [], {}
    for x in parse(html):
        if isinstance(x, Element):
            up[_signed(x.id)] = _signed(x.up.id)
        elif not x.element.marked:
            blocks.append(x)
    slots = [_slot(_signed(b.element.id), up, elements) for b in blocks]
    if blocks and not any(b.element.article or s in main for b, s in zip(blocks, slots, strict=True)):
        main, slots = _alone(html), [_signed(b.element.id) for b in blocks]
    kept = [b for b, s in zip(blocks, slots, strict=True) if b.element.article or s in main and _signed(b.id) not in texts]
    return "\n\n".join(b.text for b in kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (blocks joined by two line feeds), n_chars of every row."""
    scratch = Scratch(pages.sparkSession, "extraction")
    own = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).withColumn("host", host(F.col("url")))
    made = templates(own.select("host", "html"), scratch)
    size = made.agg(F.coalesce(F.sum(24 + F.octet_length("host") + 8 * (F.size("elements") + F.size("texts") + F.size("main"))), F.lit(0)).alias("n")).first().n
    if size <= BROADCAST_BYTES:
        met = own.join(F.broadcast(made), "host", "left")
    else:
        met = spread_join(own, made, ["host"], "html", scratch.table(heavy_keys(own, ["host"]), "hot_hosts"), "left")

    def run(ids: list, urls: list, html: list, *template: list) -> dict[str, list]:
        found = [main_text(h, *(set(x or ()) for x in t)) for h, *t in zip(html, *template, strict=True)]
        return {"page_id": ids, "url": urls, "text": found, "n_chars": [len(t) for t in found]}

    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return map_batches(met.select("page_id", "url", "html", "elements", "texts", "main"), run, schema, text="html")


def op11(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: What the method finds on pages of this one form, where an article element holds the text.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<br>', ' ', 'g') AS x FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(x, '</?(?:p|h1)>'), lambda b: trim(regexp_replace(
        replace(replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS x FROM a),
t AS (SELECT page_id, url, coalesce(array_to_string(list_filter(x, lambda b: b <> ''), chr(10) || chr(10)), '') AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""
