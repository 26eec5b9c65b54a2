"""Main text of web pages by host-wide consensus on where it stands."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, cut, portions, small

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"

_RAW = frozenset("script style textarea noscript template iframe title xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_CONTAINERS = frozenset("article blockquote body center dd div main section td".split())
_DROPPED = frozenset("nav footer aside form script style noscript template iframe button select textarea svg head title dialog menu object canvas input xmp".split())
_ROLES = frozenset("navigation banner complementary contentinfo search alert dialog menu menubar form".split())
#: Words in a class or id that mark what isn't the article.
_SIDE = re.compile(r"(?i)(?:^|[\s_-])(?:nav(?:bar|igation)?|menu|header|masthead|footer|side-?bar|aside|ads?|advert(?:s|isement)?s?|banner|promo(?:tion)?s?|sponsor(?:ed)?|cookies?|consent|gdpr|notices?|alert|pop-?up|modal|overlay|comments?|replies|reply|respond|disqus|share|sharing|social|related|recommended|breadcrumbs?|pagination|pager|newsletter|subscribe|signup|login|search|widget|toolbar|skip-?link|copyright)(?:$|[\s_-])")
#: Those that don't name readers' comments, menus, side columns or consent: they also occur on what holds the article.
_WEAK = re.compile(r"(?i)(?<![^\s_-])(?:header|masthead|banner|promo(?:tion)?s?|notices?|alert|overlay|modal|share|sharing|social|pager|subscribe|signup|login|search|widget|toolbar)(?![^\s_-])")
#: A container that only such words mark is kept if it holds this share of the page's plain text, and more plain than linked text.
_MUCH = 0.25
#: Words in a class that say how a container is laid out, or that it heads the text: none marks what isn't the article.
_LAYOUT = re.compile(r"(?i)(?<!\S)(?:(?:has|with|without|no|hide|show)[-_]\S*|(?:post|entry|article|content|story|section)[-_]+header)(?!\S)")
_HEADS = re.compile(r"(?i)(?<!\S)header(?!\S)")
#: A container marked by its class alone is kept if it holds so much of a page's plain text; so is what holds that much of its parent's.
_NEARLY_ALL = 0.9
#: An opening tag ends an open element of these kinds, as far as the nearest element in the second set.
_ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}


class _Element:
    __slots__ = ("tag", "path", "dropped", "parent", "score", "within", "side", "weak")

    def __init__(self, tag: str, path: str, dropped: bool, parent: _Element | None, within: bool, side: int | None = None, weak: bool = False):
        self.tag, self.path, self.dropped, self.parent, self.within = tag, path, dropped, parent, within
        self.side = side  # place of the element that is dropped for its class or id alone, and holds this one
        self.weak = weak  # whether that element's words are weak ones
        self.score = 0.0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTRIBUTE.finditer(text)))} if text.strip("/ \n") else {}


def _open(tag: str, attributes: str, parent: _Element | None, place: int, spared: frozenset[int]) -> _Element:
    a = _attributes(attributes)
    within = parent is not None and (parent.within or parent.tag in ("article", "main"))
    kinds = f"{a.get('class', '')} {a.get('id', '')}"
    hard = tag in _DROPPED or (tag == "header" and not within and not _LAYOUT.search(kinds)) or "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in _ROLES
    hard |= "display:none" in a.get("style", "").replace(" ", "").lower()
    marked = weak = False
    if tag not in ("html", "body", "article", "main") and place not in spared and kinds.strip():
        kinds = _LAYOUT.sub(" ", kinds)
        kinds = _HEADS.sub(" ", kinds) if within else kinds
        marked = bool(_SIDE.search(kinds))
        weak = marked and not _SIDE.search(_WEAK.sub(" ", kinds))
    above = bool(parent and parent.dropped)
    side = None if hard else parent.side if above else place if marked else None
    weak = bool(parent and parent.weak) if above else weak
    dropped = above or hard or marked
    path = parent.path if parent else ""
    if tag in _CONTAINERS or tag in ("html", "table", "tr"):
        # Generalised: the tag and its first class without digits, so that numbered variants agree.
        first = next(iter(a.get("class", "").split()), "")
        path = f"{path}>{tag}" + (f".{re.sub(r'[0-9]+', '', first).lower()}" if first else "")
    return _Element(tag, path, dropped, parent, within, side, weak)


def blocks(page: str) -> tuple[list[tuple[_Element, str]], list[_Element]]:
    """Text blocks with the container that each stands in, and all containers, in page order; what is boilerplate by itself is left out.

    What only a class or id marks as boilerplate is judged by its text, too. If weak words mark it, it stays if it
    holds ``_MUCH`` of the plain text that no other words mark, and more than it has in links; in any case it stays if it holds nearly all
    plain text and no article has any.
    """
    spared: frozenset[int] = frozenset()
    while True:
        out, containers, marked = _blocks(page, spared)
        kept = sum(len(text) for _, text in out)
        total = kept + sum(m[0] for m in marked.values())
        open_ = kept + sum(m[0] for m in marked.values() if m[2])
        more = {at for at, (plain, linked, weak) in marked.items() if weak and plain > linked and plain >= _MUCH * open_}
        most = max(marked, key=lambda at: marked[at][0], default=None)
        if most is not None and marked[most][0] >= _NEARLY_ALL * total and not any(x.within or x.tag in ("article", "main") for x, _ in out):
            more.add(most)
        if not more:
            return out, containers
        spared |= more


def _blocks(page: str, spared: frozenset[int]) -> tuple[list[tuple[_Element, str]], list[_Element], dict[int, tuple[int, int, bool]]]:
    """As ``blocks``; also the plain and linked text of what a class or id marks, by its place, and whether only weak words do."""
    root = at = _Element("#root", "", False, None, False)
    marked: dict[int, tuple[int, int, bool]] = {}
    out: list[tuple[_Element, str]] = []
    containers = [root]
    parts: list[str] = []
    linked = plain = 0
    in_link = 0

    def home(element: _Element) -> _Element:
        while element.parent is not None and element.tag not in _CONTAINERS:
            element = element.parent
        return element

    def flush() -> None:
        nonlocal linked, plain
        if parts:
            # References are decoded before white space, so that a decoded space counts as white space.
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                own = home(at)
                out.append((own, text))
                own.score += len(text) * plain / max(plain + linked, 1)
            parts.clear()
        linked = plain = 0

    def close(names: tuple[str, ...] | list[str], until: tuple[str, ...] | list[str]) -> None:
        nonlocal at
        x = at
        while x.parent is not None and x.tag not in until:
            if x.tag in names:
                at = x.parent
                return
            x = x.parent

    place, size = 0, len(page)
    while place < size:
        m = _TAG.search(page, place)
        end = m.start() if m else size
        if end > place and not at.dropped:
            text = page[place:end]
            parts.append(text)
            if in_link:
                linked += len(text)
            else:
                plain += len(text)
        elif end > place and at.side is not None:
            size_of = len(page[place:end].strip())
            if size_of:
                plain_of, linked_of, _ = marked.get(at.side, (0, 0, False))
                marked[at.side] = (plain_of, linked_of + size_of, at.weak) if in_link else (plain_of + size_of, linked_of, at.weak)
        if not m:
            break
        place = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA[") and not at.dropped:
                parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        closing, tag, attributes = m[1] or m[4], name.lower(), m[3] or m[6] or ""
        if tag in _BLOCKS:
            flush()
        elif tag == "br" and not at.dropped:
            parts.append(" ")
        if closing:
            if tag == "a":
                in_link = max(0, in_link - 1)
            close((tag,), ("#root",) if tag in _BLOCKS else tuple(_CONTAINERS))
            continue
        if tag in _RAW:
            done = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, place)
            place = done.end() if done else size
            continue
        if tag in _VOID:
            continue
        if tag in _BLOCKS and tag not in ("option",):
            close(("p",), tuple(_CONTAINERS - {"p"}) + ("li", "table"))
        if tag in _ENDS:
            names, until = _ENDS[tag]
            close(names.split(), until.split())
        if tag == "a":
            in_link = 0 if in_link else in_link  # an open link ends at the next
            in_link += 1
        at = _open(tag, attributes, at, m.start(), spared)
        if tag in _CONTAINERS:
            containers.append(at)
    flush()
    return out, containers, marked


def _lifted(path: str, own: dict[str, float], whole: dict[str, float]) -> str:
    """The path of the whole text around a container: its article or main; else the highest one that has text of its own, or
    below the body more than the container nearly has. ``own`` is the plain text that
    stands in each path itself, ``whole`` that in it and below."""
    above = [path]
    while above[-1]:
        above.append(above[-1].rpartition(">")[0])
    tag = lambda p: p.rpartition(">")[2].partition(".")[0]
    for p in above:
        if tag(p) in ("article", "main"):
            return p
    for p in above[1:]:
        if own.get(p, 0) > 0 or (p and tag(p) not in ("html", "body") and whole[path] < _NEARLY_ALL * whole[p]):
            path = p
    return path


def score_containers(page: str, top: int = 3) -> list[tuple[str, int]]:
    """The page's ``top`` container paths with votes: a container has its own blocks' plain text, and half its children's.
    Votes are for the path of the whole text around the container."""
    _, containers = blocks(page)
    own: dict[str, float] = {}
    for x in containers:
        if x.score > 0:
            own[x.path] = own.get(x.path, 0.0) + x.score
    whole: dict[str, float] = {}
    for path, n in own.items():
        whole[path] = whole.get(path, 0.0) + n
        while path:
            path = path.rpartition(">")[0]
            whole[path] = whole.get(path, 0.0) + n
    for x in reversed(containers):
        up = x.parent
        while up is not None and up.parent is not None and up.tag not in _CONTAINERS:
            up = up.parent
        if up is not None:
            up.score += x.score / 2
    by: dict[str, float] = {}
    for x in containers:
        if x.score > 0 and not x.dropped:
            by[x.path] = by.get(x.path, 0.0) + x.score
    best: dict[str, float] = {}
    for path, score in sorted(by.items(), key=lambda p: (-p[1], p[0])):
        best.setdefault(_lifted(path, own, whole), score)
        if len(best) == top:
            break
    ranked = list(best.items())
    return [(path, round(1000 * math.log1p(score) / (1 + 2 * n))) for n, (path, score) in enumerate(ranked)]


def extract(page: str, path: str | None) -> str:
    """The blocks in containers at ``path``, or below; without such, at the page's own best path."""
    found, _ = blocks(page)
    for at in (path, None):
        if at is None:
            own = score_containers(page, 1)
            at = own[0][0] if own else ""
        inside = [text for x, text in found if x.path == at or x.path.startswith(at + ">")]
        if inside:
            return "\n".join(inside)
    return ""


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, path``: where most pages of a host have their main text, by votes; ties go to the first path."""
    arrow_batches(pages.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "page"):
            votes: dict[tuple[str, str], int] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for path, n in score_containers(page):
                    votes[host, path] = votes.get((host, path), 0) + n
            if votes:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), pa.array(list(votes.values()), pa.int64())], ["host", "path", "votes"])

    rows = pages.select(host(url_col).alias("host"), F.coalesce(html_col, F.lit("")).alias("page"))
    votes = rows.mapInArrow(run, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("host").agg(F.min(F.struct(-F.col("votes"), F.col("path"))).alias("best")).select("host", "best.path")


def host(url_col: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), _HOST, 1))


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", salts: int = 32) -> DataFrame:
    """Add ``text`` and ``n_chars`` (code points) to every page.

    First each page's containers are scored by their plain text; the pages of a host vote on the
    generalised tag-class path (tags, first classes without digits) of the article, or whole text, around them. Then each page gives the blocks at
    its host's winning path, or, if it has none there, at its own best one. Menus, headers, footers,
    sidebars, notices, adverts, forms, scripts, styles and comments are left out by tag, role, class or
    id. Character references are decoded, white space in a block becomes one space, blocks are joined
    by newlines. Null or empty html gives empty text; pages without a url vote as one host; repeated
    rows give equal rows. Hosts' paths are broadcast up to a checked number of hosts; beyond it
    they are joined with the host salted, so that a host with a third of all pages is spread.
    """
    arrow_batches(pages.sparkSession, 500)
    keep = [c for c in pages.columns if c not in ("text", "n_chars")]
    paths = cut(host_paths(pages, url_col, html_col).select(F.col("host").alias("_host"), F.col("path").alias("_path")))
    rows = pages.select(*keep, host(url_col).alias("_h"), F.pmod(F.xxhash64(html_col), F.lit(salts)).alias("_s"), F.coalesce(html_col, F.lit("")).alias("_page"))
    few = small(paths)
    if few is not paths:
        rows = rows.join(few, F.col("_h") == F.col("_host"), "left").select(*keep, "_path", "_page")
    else:
        salted = paths.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.join(salted, (F.col("_h") == F.col("_host")) & (F.col("_s") == F.col("_salt")), "left").select(*keep, "_path", "_page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "_page"):
            texts = pa.array([extract(page, path) for path, page in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], texts, pc.utf8_length(texts).cast(pa.int64())], [*keep, "text", "n_chars"])

    schema = T.StructType([*pages.select(*keep).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(run, schema)
