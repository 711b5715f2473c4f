"""HTML extraction: wrappers inferred as union-free regular expressions, per host.

Pages of a host are aligned with a growing expression over block-level tags and texts. A text that is
the same on all pages stays a constant of the template; where texts differ, they become a slot. What
stands once on either side, tag or text, is an anchor, and anchors in one order on both sides are met
first, so that a footer is found again behind bodies of any kind. Between them, tags against tags become
a repeated group if the stretch repeats what stands before it, else an optional group. The expression tells which element holds the slots of the host's running text: that signature
is the host's main region. Every page is then read once: all that the region holds is taken, without what
stands in menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments;
a heading that all articles share is running text, too. Names of elements (without numbers) rank regions
that hold slots; a host without such a name gives its bodies without the template's constants, which are
its menus and footers there (if nothing else is left, the page's whole body). A text of an optional group is
not on all pages and so no constant. A page that lacks its host's region is judged by its own tags.

The inference reads all pages, whole. Pages of one structure are merged where they are read, so what is
shuffled is one row for each structure and task; structures of a host are aligned in shares, then the shares.

A page with several regions of the best kind (two articles) gives all of them, in page order.

Defined cases: null html is an empty page with an empty text; pages without a host share one wrapper; a
very long page is read whole, in the inference, too;
unclosed elements end with the block around them, an excluded element that is never closed excludes
nothing; repeated pages are extracted alike; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoq.llm.common import BROADCAST_ROWS, small, written
from convoq.llm.url_filters import host_of
from convoq.shipping import ship

#: Shares of a host's structures, so that a hot host is aligned by several tasks.
SALTS = 32
#: Structures that a task holds before it sends them on.
HELD = 5_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?"
    r"|<(script|style|noscript|template|textarea|svg|iframe|title|xmp)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[a-z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Inline elements that part words.
SPACES = frozenset(("br", "img", "wbr"))
#: Elements, ARIA roles and words of class or id whose content is not running text.
DROP_TAGS = frozenset("nav footer aside form button select menu dialog object embed audio video canvas head fieldset label".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored banner cookie cookies consent gdpr notice notices newsletter "
    "subscribe subscription signup popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar aside "
    "comment comments disqus replies footer masthead copyright pagination pager login".split()
)
#: The only ones of these words that make an article something else than running text.
ARTICLE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored comment comments disqus replies".split())
#: Words for menus that may as well name running text: their elements go if at least half of their text is links.
LINK_WORDS = frozenset("share sharing social related recommended recommendations widget widgets promo promotion toolbar".split())
MAIN_WORDS = frozenset("article content post entry story main body text".split())


@dataclass
class Tag:
    name: str
    close: bool
    hints: frozenset[str] = frozenset()
    roles: frozenset[str] = frozenset()
    hidden: bool = False

    @property
    def signature(self) -> str:
        """What names a region: the tag, for general tags with the words of class and id; numbers count pages, not kinds."""
        return self.name if self.name in ("article", "main", "body") else ".".join([self.name, *sorted(w for w in self.hints if not w.isdigit())])


def _tag(close: str, name: str, attributes: str) -> Tag:
    if not attributes or close:
        return Tag(name, bool(close))
    got = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
    hints = frozenset(_WORDS.findall(f"{got.get('class', '')} {got.get('id', '')}"))
    style = got.get("style", "").replace(" ", "")
    hidden = "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
    roles = frozenset(got.get("role", "").split())
    return Tag(name, False, hints | ({"articlebody"} if got.get("itemprop") == "articlebody" else frozenset()), roles, hidden)


def tokens(page: str) -> list[Tag | str]:
    """Tags and texts of a page; comments, declarations and raw elements (scripts, styles) are left out."""
    out: list[Tag | str] = []
    for m in _TOKEN.finditer(page):
        if m[3]:
            out.append(_tag(m[2], m[3].lower(), m[4]))
        else:
            text = m[0]
            if text[0] != "<" or text == "<":
                out.append(text)
            elif text.startswith("<![CDATA["):
                out.append(text[9:-3])
    return out


# Inference -----------------------------------------------------------------------------------------------------------

SLOT = "#text"


@dataclass
class Group:
    """An optional (?) or repeated (+) stretch of an expression; seen has all texts of a repeat that is the same on all pages."""

    items: list
    kind: str
    seen: tuple[str, ...] | None = None


def text_key(before: str, text: str) -> str:
    """A stretch of text as the alignment compares it: its value and the block tag before it."""
    return "=" + xxhash.xxh3_64_hexdigest(f"{before}\0{text}")


def _is_text(x) -> bool:
    return isinstance(x, str) and (x == SLOT or x[0] == "=")


def _key(x):
    """What must agree for two items to stand for each other: tags, but not the values of texts."""
    return tuple(_key(y) for y in x.items) if isinstance(x, Group) else SLOT if _is_text(x) else x


def _merged(x, y):
    """The item for two that stand for each other: texts that differ are a slot."""
    if isinstance(x, Group):
        kind = x.kind if x.kind == y.kind else "?"
        return Group([_merged(p, q) for p, q in zip(x.items, y.items, strict=True)], kind, x.seen if kind == "+" and x.seen == y.seen else None)
    return x if x == y or not _is_text(x) else SLOT


def normal(pieces: list[str]) -> str:
    return " ".join(entities.unescape("".join(pieces)).split())


def stream(page: str) -> list:
    """A page as the alignment sees it: block tags by signature, and each stretch of text by its value."""
    out: list[str] = []
    now: list[str] = []
    before = ""

    def close() -> None:
        if text := normal(now):
            out.append(text_key(before, text))
        now.clear()

    for t in tokens(page):
        if isinstance(t, str):
            now.append(t)
        elif t.name in BLOCK:
            close()
            before = named(t)
            out.append(before)
        elif t.name in SPACES:
            now.append(" ")
    close()
    return folded(out)


def named(t: Tag) -> str:
    return f"</{t.name}>" if t.close else f"<{t.signature}>"


def folded(items: list) -> list:
    """Repeats of a stretch of up to 6 items become one repeated group that knows all their texts."""
    keys = [_key(x) for x in items]
    out: list = []
    i = 0
    while i < len(items):
        for size in range(1, 7):
            unit, n = keys[i : i + size], 1
            while len(unit) == size and keys[i + n * size : i + (n + 1) * size] == unit:
                n += 1
            if n > 1 and SLOT != unit[0]:
                out.append(Group(unit, "+", tuple(x for x in items[i : i + n * size] if _is_text(x))))
                i += n * size
                break
        else:
            out.append(items[i])
            i += 1
    return out


def align(a: list, b: list) -> list:
    """The expression that covers a and b: texts that differ become slots, other mismatches repeated groups if they can, else optional ones."""
    out: list = []
    i = j = 0
    for p, q in [*_anchors(a, b), (len(a), len(b))]:
        out += _between(a[i:p], b[j:q])
        if p < len(a):
            out.append(_merged(a[p], b[q]))
        i, j = p + 1, q + 1
    return out


def _anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Places of items that stand once in a and once in b, texts and repeats by their values: the most of them that are in one order."""
    name = lambda x: x if isinstance(x, str) else (_key(x), x.seen)
    once = lambda items: {k: i[0] for k, i in _places([name(x) for x in items]).items() if len(i) == 1 and k != SLOT}
    at_a, at_b = once(a), once(b)
    pairs = sorted((i, at_b[k]) for k, i in at_a.items() if k in at_b)
    ends: list[int] = []  # of chains by length, the one that ends first in b
    last: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        before[n] = last[k - 1] if k else -1
        ends[k:], last[k:] = [j, *ends[k + 1 :]], [n, *last[k + 1 :]]
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _optional(items: list) -> list:
    """Items that only one side has: stretches of them are one optional group each."""
    out: list = []
    now: Group | None = None
    for x in items:
        if isinstance(x, Group) and x.kind == "?":
            out.append(x)
            now = None
        elif now:
            now.items.append(x)
        else:
            now = Group([x], "?")
            out.append(now)
    return out


def _between(a: list, b: list) -> list:
    if not a or not b:
        return _optional(a or b)
    ka, kb = [_key(x) for x in a], [_key(x) for x in b]
    if ka == kb:
        return [_merged(x, y) for x, y in zip(a, b, strict=True)]
    at_a, at_b = _places(ka), _places(kb)
    out: list = []
    i = j = 0
    while i < len(a) and j < len(b):
        x, y = a[i], b[j]
        if ka[i] == kb[j]:
            out.append(_merged(x, y))
            i, j = i + 1, j + 1
            continue
        if isinstance(x, Group) and x.kind == "+" and tuple(kb[j : j + len(x.items)]) == ka[i]:
            out.append(Group(x.items, "+"))  # one turn of a repeat
            i, j = i + 1, j + len(x.items)
            continue
        if isinstance(y, Group) and y.kind == "+" and tuple(ka[i : i + len(y.items)]) == kb[j]:
            out.append(Group(y.items, "+"))
            i, j = i + len(y.items), j + 1
            continue
        if isinstance(x, Group) and x.kind == "?":
            n = len(x.items) if tuple(kb[j : j + len(x.items)]) == ka[i] else 0
            out.append(_merged(x, Group(b[j : j + n], "?")) if n else x)
            i, j = i + 1, j + n
            continue
        if isinstance(y, Group) and y.kind == "?":
            n = len(y.items) if tuple(ka[i : i + len(y.items)]) == kb[j] else 0
            out.append(_merged(y, Group(a[i : i + n], "?")) if n else y)
            i, j = i + n, j + 1
            continue
        # The nearest place where one side meets the other's item again: what lies between is optional.
        ahead_a, ahead_b = _after(at_a, kb[j], i), _after(at_b, ka[i], j)
        if ahead_b is not None and (ahead_a is None or ahead_b - j <= ahead_a - i):
            out.append(Group(b[j:ahead_b], "?"))
            j = ahead_b
        elif ahead_a is not None:
            out.append(Group(a[i:ahead_a], "?"))
            i = ahead_a
        else:
            out += [Group([x], "?"), Group([y], "?")]
            i, j = i + 1, j + 1
    return out + _optional(a[i:]) + _optional(b[j:])


def _places(keys: list) -> dict:
    found: dict = {}
    for i, k in enumerate(keys):
        found.setdefault(k, []).append(i)
    return found


def _after(places: dict, key, i: int) -> int | None:
    at = places.get(key, [])
    k = bisect_right(at, i)
    return at[k] if k < len(at) else None


def infer(pages: list[str]) -> list:
    """The expression of some pages."""
    expression: list = []
    for k, page in enumerate(pages):
        expression = stream(page) if not k else align(expression, stream(page))
    return expression


def as_text(items: list) -> str:
    return " ".join(f"( {as_text(x.items)} ){x.kind}" if isinstance(x, Group) else SLOT if _is_text(x) else x for x in items)


def open_slots(expression: list) -> list:
    """The expression of a single page, whose texts nothing has been compared with: all of them are slots."""
    return [Group(x.items, x.kind) if isinstance(x, Group) else SLOT if _is_text(x) else x for x in expression]


def template(expression: list) -> list[str]:
    """The texts that stand on all pages of an expression, as often as they stand there."""
    return [k for x in expression for k in ((x.seen or ()) if isinstance(x, Group) else (x,) if x[0] == "=" else ())]


def _flat(items: list) -> Iterator[str]:
    """Tags and slots; a text that stands on all pages is left out, one that only some pages have is a slot."""
    for x in items:
        if isinstance(x, Group):
            yield from (y for y in _leaves(x.items) if not (x.seen and _is_text(y)))
        elif x[0] != "=":
            yield x


def _leaves(items: list) -> Iterator[str]:
    for x in items:
        yield from _leaves(x.items) if isinstance(x, Group) else (SLOT if _is_text(x) else x,)


def main_region(expression: list) -> str:
    """The signature of the element that an expression's running text stands in; '' without one."""
    slots: dict[str, int] = {}
    stack: list[str] = []
    for x in _flat(expression):
        if x == SLOT:
            for s in set(stack):
                slots[s] = slots.get(s, 0) + 1
        elif x.startswith("</"):
            name = x[2:-1]
            while stack and any(s.split(".")[0] == name for s in stack) and stack.pop().split(".")[0] != name:
                pass
        else:
            stack.append(x[1:-1])
    worth = {s: (_rank(s), n) for s, n in slots.items() if _rank(s)}
    return max(worth, key=lambda s: (*worth[s], s)) if worth else ""


def _rank(signature: str) -> int:
    name, *words = signature.split(".")
    if DROP_WORDS & set(words) or name in DROP_TAGS:
        return 0
    if name == "article":
        return 4
    if "articlebody" in words:
        return 3
    if name == "main":
        return 2
    return int(name in ("div", "section", "td") and bool(MAIN_WORDS & set(words)))


# Extraction ----------------------------------------------------------------------------------------------------------


def _ends(items: list[Tag | str]) -> dict[int, int]:
    """Where each element that is closed ends: opening token -> closing token."""
    open_at: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    for i, t in enumerate(items):
        if isinstance(t, str) or t.name in VOID:
            continue
        if not t.close:
            open_at.setdefault(t.name, []).append(i)
        elif stack := open_at.get(t.name):
            ends[stack.pop()] = i
    return ends


def _dropped(items: list[Tag | str], i: int, end: int, inside: bool) -> bool:
    """Whether the element from items[i] to items[end] is no running text."""
    t = items[i]
    if t.name in DROP_TAGS or t.hidden or (t.name == "header" and not inside) or t.roles & DROP_ROLES:
        return True
    if t.name in ("body", "html", "main"):
        return False
    if t.name == "article":
        return bool(t.hints & ARTICLE_WORDS)
    return bool(t.hints & DROP_WORDS or (t.hints & LINK_WORDS and _is_menu(items[i + 1 : end])))


def _is_menu(items: list[Tag | str]) -> bool:
    links = texts = depth = 0
    for t in items:
        if isinstance(t, str):
            n = len("".join(t.split()))
            texts, links = texts + n, links + n * (depth > 0)
        elif t.name in ("a", "button"):
            depth = max(0, depth + (-1 if t.close else 1))
    return 2 * links >= texts


def _blocks(items: list[Tag | str], ends: dict[int, int], start: int, stop: int, inside: bool, constant: Counter[str]) -> list[str]:
    """Texts of blocks without those that the host's expression has as constant ones; each constant is met once."""
    out: list[str] = []
    now: list[str] = []
    before = named(items[start - 1]) if start else ""

    def close() -> None:
        if text := normal(now):
            key = text_key(before, text) if constant else ""
            if constant[key]:
                constant[key] -= 1
            else:
                out.append(text)
        now.clear()

    i = start
    while i < stop:
        t = items[i]
        if isinstance(t, str):
            now.append(t)
        else:
            if not t.close and i in ends and _dropped(items, i, ends[i], inside):
                if t.name in BLOCK:
                    close()
                    before = f"</{t.name}>"
                i = ends[i] + 1
                continue
            if t.name in BLOCK:
                close()
                before = named(t)
            elif t.name in SPACES:
                now.append(" ")
        i += 1
    close()
    return out


def extract(page: str | None, region: str = "", constant: Sequence[str] = ()) -> str:
    """The main text: all that elements with signature region hold, else those of the best region of the page that has any.

    A page without such an element gives its body without the host's constants (with them, if nothing is left);
    excluded elements are left out everywhere.
    """
    if not page:
        return ""
    items = tokens(page)
    ends = _ends(items)
    found: dict[str, list[tuple[int, int]]] = {}
    skip = 0
    for i, t in enumerate(items):
        if isinstance(t, str) or t.close or i < skip:
            continue
        if i in ends and _dropped(items, i, ends[i], True):
            skip = ends[i]
        elif _rank(s := t.signature):
            end = ends.get(i, len(items))
            spans = found.setdefault(s, [])
            if not spans or i >= spans[-1][1]:
                spans.append((i, end))
    size = lambda spans: sum(len(x) for a, b in spans for x in items[a:b] if isinstance(x, str))
    for best in sorted(found, key=lambda s: (s == region, _rank(s), size(found[s]), s), reverse=True):
        spans = found[best]
        if blocks := [x for a, b in spans for x in _blocks(items, ends, a + 1, b, True, Counter())]:
            return "\n\n".join(blocks)
    body = next((i for i, t in enumerate(items) if not isinstance(t, str) and t.name == "body" and not t.close), -1)
    return "\n\n".join(_blocks(items, ends, body + 1, len(items), False, Counter(constant)) or _blocks(items, ends, body + 1, len(items), False, Counter()))


# Folding all pages ---------------------------------------------------------------------------------------------------

_FOLDED = "host string, salt int, structure string, items string, page string, several boolean, n long"


def _packed(items: list) -> str:
    plain = lambda xs: [[x.kind, plain(x.items), x.seen] if isinstance(x, Group) else x for x in xs]
    return json.dumps(plain(items), separators=(",", ":"))


def _unpacked(text: str) -> list:
    group = lambda xs: [x if isinstance(x, str) else Group(group(x[1]), x[0], None if x[2] is None else tuple(x[2])) for x in xs]
    return group(json.loads(text))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of one structure become one expression before they leave the task: a text that differs is a slot."""
    held: dict[tuple[str, str], list] = {}

    def out() -> pa.RecordBatch:
        rows = [(host, int(structure[:8], 16) % SALTS, structure, _packed(items), page, several, n) for (host, structure), (items, page, several, n) in held.items()]
        held.clear()
        types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64())
        names = [x.split()[0] for x in _FOLDED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    for b in small(batches):
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            items, name = stream(page), xxhash.xxh3_64_hexdigest(page)
            structure = xxhash.xxh3_64_hexdigest(json.dumps(list(map(_key, items))))
            if mine := held.get((host, structure)):
                mine[0], mine[2], mine[3] = align(mine[0], items), mine[2] or name != mine[1], mine[3] + 1
            else:
                held[host, structure] = [items, name, False, 1]
            if len(held) >= HELD:
                yield out()
    if held:
        yield out()


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for several of a host: first those of one structure are merged, then structures are aligned in a fixed order."""
    expression: list | None = None
    for _, same in pdf.sort_values(["structure", "page"]).groupby("structure"):
        mine: list | None = None
        for items in map(_unpacked, same["items"]):
            mine = items if mine is None else align(mine, items)
        expression = mine if expression is None else align(expression, mine)
    several = bool(pdf["several"].any()) or pdf["page"].nunique() > 1
    return pd.DataFrame({"host": pdf["host"].iloc[:1], "salt": pdf["salt"].iloc[:1], "structure": pdf["structure"].min(), "items": _packed(expression), "page": pdf["page"].min(), "several": several, "n": pdf["n"].sum()})


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, n_pages, expression, region, constant) for every host, from all of its n_pages pages.

    Tasks send one row for each structure they meet, structures of a host are aligned in SALTS shares, the shares by host.
    """
    keyed = pages.where("html is not null").select(host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    shares = keyed.mapInArrow(_fold, _FOLDED).groupBy("host", "salt").applyInPandas(_joined, _FOLDED)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = _joined(pdf.assign(structure=pdf["salt"].map("{:08d}".format)))
        expression = _unpacked(whole["items"].iloc[0])
        if not whole["several"].iloc[0]:
            expression = open_slots(expression)
        return pd.DataFrame({"host": whole["host"], "n_pages": whole["n"], "expression": as_text(expression), "region": main_region(expression), "constant": [template(expression)]})

    return shares.groupBy("host").applyInPandas(run, "host string, n_pages long, expression string, region string, constant array<string>")


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, region) for every page."""
    ship(pages.sparkSession)
    found = written(wrappers(pages), "wrappers").select("host", "region", "constant")
    if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    page = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host_of(F.col("url").cast("string")).alias("host"))
    page = page.join(found, "host", "left").select("page_id", "url", "html", F.coalesce("region", F.lit("")).alias("region"), F.coalesce("constant", F.array().cast("array<string>")).alias("constant"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = [extract(*x) for x in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), b.column(3)],
                ["page_id", "url", "text", "n_chars", "region"],
            )

    return page.mapInArrow(run, "page_id long, url string, text string, n_chars long, region string")
