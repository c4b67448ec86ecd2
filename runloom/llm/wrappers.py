"""Main text of web pages by inferred wrappers.

Pages of a host share templates.  Each page becomes a stream of block tags and text
blocks; like blocks in a row fold into one repeated group.  Streams of a template
are aligned one after another: equal tags match, differing texts become slots, equal ones
stay constants, and what only one side has becomes optional.  The result is a
union-free regular expression, the template's wrapper, with counts per group.

A page's article is what its container holds outside menus, headers, footers, asides,
notices, adverts, forms and comments.  The container is the page's ``article`` or
``main`` element; where it has none, the element with the most text outside links.
Pages of a host with one container share a template; no page is judged by another
template.  The wrapper says what is the template's own text: a single group that every
page of it has, with one text on at least DISTINCT pages of differing content.  Such
lines go, unless they outweigh the slots, when the pages are copies of one article.

Tasks align the pages they hold, then partial wrappers of a template are merged in two
rounds (salted, then whole), so a host with a third of all pages is no hot group.

Defined results: a null or empty page has an empty text; a null URL belongs to the
empty host; broken markup is read to the end; repeated rows repeat; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.urls import host_path

SALTS = 64
DISTINCT = 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|select|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>"
    r"|[^<]+|<",
    re.S | re.I,
)
_CLASS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")

#: Elements that stand in a line of text; all others border text blocks.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the same group closes.
CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
MAIN = frozenset(("article", "main"))
#: Elements within an article, never its container.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption details summary section address".split())
BOILER = frozenset("nav footer aside form head button dialog menu".split())
_ROLE = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|widgets?|related|notices?|cookies?|consent|banner|alert|popup|modal|newsletter|subscribe"
    r"|ads?|advert|adverts|advertisement|sponsor|sponsored|promo|promotion|comments?|replies|respond|disqus|share|sharing|social|toolbar|search|login|signup|form|skip)(?:$|[\s_-])"
)

Block = tuple[tuple[str, ...], str, int]  # path of block elements, text, characters in links


def blocks(html: str | None) -> list[Block]:
    """Text blocks of a page in page order."""
    out: list[Block] = []
    path: list[tuple[str, str]] = []
    parts: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                out.append((tuple(s for _, s in path), text, min(linked, len(text))))
            parts.clear()
        linked = 0

    for m in _TOKEN.finditer(html or ""):
        name = m[3]
        if name is None:
            raw = m[0]
            if raw[0] != "<" or raw == "<":
                parts.append(raw)
                linked += len(raw) if in_link else 0
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                in_link = not m[2]
            if name in ("br", "img"):
                parts.append(" ")
            continue
        flush()
        in_link = False
        names = [n for n, _ in path]
        if m[2]:
            if name in names:
                del path[len(names) - 1 - names[::-1].index(name) :]
            continue
        closing = set(CLOSES.get(name, "").split()) | ({"p"} if name in _ENDS_P else set())
        while path and path[-1][0] in closing:
            path.pop()
        if name in VOID or m[0].endswith("/>"):
            continue
        marks = " ".join((a or b or c).lower() for _, a, b, c in _CLASS.findall(m[4]))
        path.append((name, f"{name}.{_DIGITS.sub('0', marks)}" if marks else name))
    flush()
    return out


def stream(page: list[Block]) -> list[dict]:
    """Groups of a page: like blocks in a row are one repeated group."""
    out: list[dict] = []
    content = zlib.crc32("\n".join(text for _, text, _ in page).encode("utf-8", "surrogatepass"))
    for path, text, linked in page:
        key = "/".join(path)
        if out and out[-1]["key"] == key:
            g = out[-1]
            g["rep"], g["const"] = True, None
            g["chars"] += len(text)
            g["linked"] += linked
        else:
            out.append({"key": key, "rep": False, "opt": False, "const": text, "pages": 1, "chars": len(text), "linked": linked, "seen": [content]})
    return out


def align(a: list[dict], b: list[dict]) -> list[dict]:
    """Wrapper that fits all that either side fits."""
    out: list[dict] = []
    match = SequenceMatcher(None, [g["key"] for g in a], [g["key"] for g in b], autojunk=False)
    for op, i, j, k, n in match.get_opcodes():
        if op == "equal":
            for x, y in zip(a[i:j], b[k:n]):
                out.append(
                    {
                        "key": x["key"],
                        "rep": x["rep"] or y["rep"],
                        "opt": x["opt"] or y["opt"],
                        "const": x["const"] if x["const"] == y["const"] else None,
                        "pages": x["pages"] + y["pages"],
                        "chars": x["chars"] + y["chars"],
                        "linked": x["linked"] + y["linked"],
                        "seen": sorted({*x["seen"], *y["seen"]})[:DISTINCT],
                    }
                )
        else:
            out += [{**g, "opt": True} for g in (*a[i:j], *b[k:n])]
    return out


def _boiler(path: list[str]) -> bool:
    inside = False
    for step in path:
        name, _, marks = step.partition(".")
        if name in BOILER or (name == "header" and not inside) or (marks and name not in MAIN and name not in ("html", "body") and _ROLE.search(marks)):
            return True
        inside = inside or name in MAIN
    return False


def article_blocks(page: list[Block]) -> tuple[str, list[Block]]:
    """The page's container and the blocks in it that are no boilerplate."""
    held = [x for x in page if not _boiler(list(x[0]))]
    inner = [x for x in held if any(s.partition(".")[0] in MAIN for s in x[0])]
    if inner:
        first = inner[0][0]
        return "/".join(first[: 1 + next(i for i, s in enumerate(first) if s.partition(".")[0] in MAIN)]), inner
    weight: dict[tuple[str, ...], int] = {}
    for path, text, linked in held:
        while path and path[-1].partition(".")[0] in FLOW:
            path = path[:-1]
        if 2 * linked < len(text):
            weight[path] = weight.get(path, 0) + len(text) - linked
    if not weight:
        return "", []
    best = max(weight, key=lambda k: (weight[k], k))
    return "/".join(best), [x for x in held if x[0][: len(best)] == best]


def constants(wrapper: list[dict]) -> list[tuple[str, str]]:
    """Key and text of the groups that are the template's own."""
    own = [g for g in wrapper if g["const"] is not None and not g["rep"] and not g["opt"] and len(g["seen"]) >= DISTINCT]
    if 2 * sum(g["chars"] for g in own) >= sum(g["chars"] for g in wrapper):
        return []
    return sorted({(g["key"], g["const"]) for g in own})


def _merged(wrappers: list[str]) -> str:
    out = json.loads(wrappers[0])
    for w in wrappers[1:]:
        out = align(out, json.loads(w))
    return json.dumps(out)


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, container, article: the blocks of every page's container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [article_blocks(blocks(html)) for html in batch.column(3).to_pylist()]
            article = pa.array([json.dumps([("/".join(p), t, n) for p, t, n in held]) for _, held in found], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([c for c, _ in found], pa.string()), article], names=["page_id", "url", "host", "container", "article"]
            )

    read = pages.select("page_id", "url", "host", "html")
    return read.mapInArrow(run, "page_id long, url string, host string, container string, article string")


def _article(text: str) -> list[Block]:
    return [(tuple(p.split("/")) if p else (), t, n) for p, t, n in json.loads(text)]


def infer(read: DataFrame) -> DataFrame:
    """host, container, wrapper: the merged wrapper of every template."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes: dict[tuple, list[dict]] = {}
            for host, container, article in zip(*(batch.column(i).to_pylist() for i in range(3))):
                groups = stream(_article(article))
                shape = (host or "", container, *(g["key"] for g in groups))
                shapes[shape] = align(shapes[shape], groups) if shape in shapes else groups
            found: dict[tuple[str, str], list[dict]] = {}
            for (host, container, *_), groups in sorted(shapes.items()):
                at = (host, container)
                found[at] = align(found[at], groups) if at in found else groups
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in found], pa.string()), pa.array([c for _, c in found], pa.string()), pa.array([json.dumps(w) for w in found.values()], pa.string())],
                names=["host", "container", "wrapper"],
            )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[:1].copy()
        out["wrapper"] = _merged(sorted(pdf["wrapper"]))
        return out

    schema = "host string, container string, wrapper string, salt long"
    parts = read.select("host", "container", "article").mapInArrow(partial, "host string, container string, wrapper string")
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    salted = parts.groupBy("host", "container", "salt").applyInPandas(merge, schema)
    return salted.groupBy("host", "container").applyInPandas(merge, schema).drop("salt")


def main_text(article: list[Block], own: frozenset[tuple[str, str]]) -> str:
    kept = [text for path, text, _ in article if ("/".join(path), text) not in own]
    return "\n".join(kept or [text for _, text, _ in article])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    host, _ = host_path(F.col("url"))
    read = read_pages(pages.select("page_id", "url", "html", F.coalesce(host, F.lit("")).alias("host")))

    def own_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json.dumps(constants(json.loads(w))) for w in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.string())], names=["host", "container", "own"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for article, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                texts.append(main_text(_article(article), frozenset(map(tuple, json.loads(own or "[]")))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    chosen = infer(read).mapInArrow(own_lines, "host string, container string, own string").where("own <> '[]'")
    # a page goes with its template's lines; hot templates are split by the adaptive skew join
    joined = read.join(chosen, ["host", "container"], "left").select("page_id", "url", "article", "own")
    return joined.mapInArrow(apply, "page_id long, url string, text string, n_chars long")
