"""Main text of web pages by wrappers that are inferred for each host.

A page is a stream of block tags and texts. Its shape is a union-free regular expression: neighbouring
equal stretches are folded into a repeated group, and an element that holds text alone counts as
a group of one. The distinct shapes of a host are aligned, `FAN_IN` at a time and round after round
until one is left, so that no task has more than that many: what matches stays, what does not becomes
an optional group, and the result is folded again. Shapes are combined before they are shuffled.

The wrapper numbers the host's text slots; a page's texts find theirs by aligning the page's shape with
the wrapper once more. For each slot Spark gathers on how many pages it stands, how much text and how
much of it in links, and whether its words are always the same. That is what decides:

* A slot whose words are the same on all the host's pages, while others differ, is template; in an
  article only if it is a small part of it and no heading.
* Where no element is named article or main, the article is the innermost element that holds nearly all of the host's
  varying text outside links, and the first heading before it.
* Class words and the like are hints. Those on an element that holds most of that text are wrong.

Until a host has enough pages that differ, the names of elements and the hints decide alone.
"""

from __future__ import annotations

import html
import re
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, column_texts

#: Pages that a slot must stand on, and different contents that others must have, before it is template; the same in an article.
LEAST_PAGES, LEAST_IN_ARTICLE = 3, 5
#: The share of a host's varying text that its article holds at least, and that is too much for what a hint puts aside.
ARTICLE_SHARE, HINT_SHARE = 0.9, 0.5
#: The share of an article's text that template in it makes up at most.
TEMPLATE_SHARE = 0.2
#: Elements that may hold a part of their own, such as a notice. A standing line beside text that varies is the article's: a label, a licence.
BOXES = {"div", "section", "ul", "ol", "dl", "table", "figure", "details"}
#: Bytes of wrappers that are sent to all tasks at most; more are joined by a shuffle of the pages.
MOST_BROADCAST = 8 << 20
#: Shapes that a task aligns at once.
FAN_IN = 64
#: Tokens that a repeated group spans at most when a page's stream is folded.
LONGEST_GROUP = 64

# HTML's element names by their part in a page.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DROPPED = {"head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", *RAW}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in a class or id, and roles, that hint at what is no part of an article.
ASIDE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "menu", "modal", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "promotion", "related", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
#: Words that stand beside such a word and leave its meaning: "comment-list", but not "notice-period" or "related-work".
PLAIN_WORDS = {"area", "bar", "block", "bottom", "box", "container", "content", "inner", "item", "items", "left", "list", "main", "outer", "page", "right", "section", "site", "top", "wrap", "wrapper"}
#: Such words that hint at a page's frame, but may also stand for the head of an article within it.
FRAME_WORDS = {"footer", "header", "masthead", "nav", "topbar"}
ASIDE_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>"""
    r"|<[!?/][^>]*>?"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
#: Any attribute with its value, so that a name within another's quoted value is none.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_HOST = r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty for null and where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def _label(name: str, rest: str) -> str:
    """A tag's token: its name, with "!" if its attributes hint that it is put aside, and "~" if that it is part of the frame.

    Ids of headings and inline elements are anchors, often made of the text's own words, and say nothing.
    """
    frame = False
    for m in _ATTRIBUTE.finditer(rest):
        kind = m[1].lower()
        if kind not in ("class", "id", "role", "hidden") or kind == "id" and (name in _HEADINGS or name in INLINE):
            continue
        value = (m[2] or m[3] or m[4] or "").lower()
        if kind == "hidden" or (kind == "role" and value in ASIDE_ROLES):
            return f"{name}!"
        for one in () if kind == "role" else value.split():
            words = {w for w in re.split(r"[^a-z]+", one) if w}
            if words - ASIDE_WORDS - FRAME_WORDS - PLAIN_WORDS:
                continue
            if words & ASIDE_WORDS:
                return f"{name}!"
            frame = frame or bool(words & FRAME_WORDS)
    return f"{name}~" if frame else name


def events(page: str | None):
    """("<", label), (">", label) and ("#", text) in page order, with implied end tags written out.

    An end tag closes up to its nearest open element; one that matches none is ignored. What is
    open at the end is closed there.
    """
    stack: list[str] = []

    def close(upto: int):
        while len(stack) > upto:
            yield ">", stack.pop()

    for m in _TOKEN.finditer(page or ""):
        if m["text"]:
            yield "#", m["text"]
        elif m["name"]:
            name = m["name"].lower()
            names = [s.rstrip("!~") for s in stack]
            if m["close"]:
                if name in names:
                    yield from close(len(names) - 1 - names[::-1].index(name))
                continue
            if name in ENDS_P and "p" in names:
                at = len(names) - 1 - names[::-1].index("p")
                if not {"td", "th", "li", "button", "object"} & set(names[at:]):
                    yield from close(at)
            elif name in SIBLINGS:
                for at in range(len(names) - 1, -1, -1):
                    if names[at] in ("ul", "ol", "dl", "table", "select"):
                        break
                    if names[at] in SIBLINGS[name]:
                        yield from close(at)
                        break
            label = _label(name, m["rest"])
            yield "<", label
            if name in VOID or m["rest"].rstrip().endswith("/") and name not in ENDS_P:
                yield ">", label
            else:
                stack.append(label)
    yield from close(0)


# ---- Wrappers. A node is a token, ("+", nodes) or ("?", nodes). A text token stands for all texts between two block tags.


def parsed(page: str | None) -> tuple[list[str], list[tuple]]:
    """A page's tokens, and its texts as (token number, text, starts a block, in a link); blanks between tags have no token."""
    tokens: list[str] = []
    texts: list[tuple] = []
    links, fresh = 0, True
    for kind, value in events(page):
        if kind == "#":
            if value.strip() and (not tokens or tokens[-1] != "#"):
                tokens.append("#")
            texts.append((len(tokens) - 1 if tokens and tokens[-1] == "#" else -1, value, fresh, links > 0))
            fresh = False
            continue
        name = value.rstrip("!~")
        if name == "a":
            links += 1 if kind == "<" else -1
        if name == "br" and kind == "<":
            texts.append((-1, " ", False, False))
        if name not in INLINE or name != value:
            tokens.append(f"<{value}" if kind == "<" else f"</{value}")
            fresh = fresh or name not in INLINE
    return tokens, texts


def fold(nodes: list, own: list | None = None) -> list:
    """Neighbouring equal stretches become one repeated group, short ones first.

    own holds for each node its text slots in order, each a list of numbers; it is folded alongside.
    """
    own = [[] for _ in nodes] if own is None else own
    out: list = []
    slots: list = []

    def add(node, held):
        if out and out[-1] == node and not isinstance(node, str):
            for a, b in zip(slots[-1], held, strict=True):
                a += b
        else:
            out.append(node)
            slots.append(held)

    for x, held in zip(nodes, own, strict=True):  # an element that holds text alone is a group of one
        if isinstance(x, str) and x[:2] == "</" and len(out) >= 2 and out[-1] == "#" and out[-2] == f"<{x[2:]}":
            whole, inner = ("+", (out[-2], "#", x)), slots[-1]
            del out[-2:], slots[-2:]
            add(whole, inner)
        else:
            out.append(x)
            slots.append(held)
    size = 1
    while size <= min(LONGEST_GROUP, len(out) // 2):
        i, found, kept = 0, [], []
        while i < len(out):
            block = out[i : i + size]
            j = i + size
            if j < len(out) and out[j] == out[i] and out[j : j + size] == block and _whole(block):
                held = [list(x) for part in slots[i:j] for x in part]
                while out[j : j + size] == block:
                    for a, b in zip(held, (x for part in slots[j : j + size] for x in part), strict=True):
                        a += b
                    j += size
                found.append(block[0] if size == 1 and block[0][0] == "+" else ("+", tuple(block)))
                kept.append(held)
                i = j
            else:
                found.append(out[i])
                kept.append(slots[i])
                i += 1
        size = 1 if len(found) < len(out) else size + 1
        out, slots = found, kept
    own[:] = slots
    return out


def _whole(block: list) -> bool:
    """Whether every element that starts in the block ends there, and the other way round."""
    depth = 0
    for x in block:
        if isinstance(x, str) and x[0] == "<":
            depth += -1 if x[1] == "/" else 1
            if depth < 0:
                return False
    return depth == 0


def shape(tokens: list[str]) -> tuple[list, list[list[int]]]:
    """The folded tokens, and for each text slot the numbers of its tokens."""
    own = [[[i]] if x == "#" else [] for i, x in enumerate(tokens)]
    nodes = fold(tokens, own)
    return nodes, [x for part in own for x in part]


def align(a: list, b: list) -> list:
    """One wrapper for what either stands for."""
    if a == b:
        return a
    bare = lambda nodes: [x[1] if x[0] == "?" else (x,) for x in nodes]
    left, right = bare(a), bare(b)
    out: list = []
    for tag, i, j, k, m in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if tag == "equal":
            out += [x if x[0] == "?" else y for x, y in zip(a[i:j], b[k:m], strict=True)]
            continue
        for part in (a[i:j], b[k:m]):
            flat = [y for x in part for y in (x[1] if x[0] == "?" else (x,))]
            if flat and (not out or out[-1] != ("?", tuple(flat))):
                out.append(("?", tuple(flat)))
    return fold(out)


def write(nodes) -> str:
    return " ".join(x if isinstance(x, str) else f"( {write(x[1])} ){x[0]}" for x in nodes)


def read(text: str) -> list:
    stack: list = [[]]
    for x in text.split():
        if x == "(":
            stack.append([])
        elif x[0] == ")":
            inner = stack.pop()
            stack[-1].append((x[1], tuple(inner)))
        else:
            stack[-1].append(x)
    return stack[0]


def leaves(nodes) -> tuple[list[str], list[tuple]]:
    """The tokens without groups, texts with their paths; and for each text slot the elements round it, as (place, label)."""
    tokens: list[str] = []
    slots: list[tuple] = []
    stack: list[tuple] = []

    def walk(part):
        for x in part:
            if not isinstance(x, str):
                walk(x[1])
            elif x == "#":
                slots.append(tuple(stack))
                tokens.append("#" + "/".join(label for _, label in stack))
            else:
                if x[1] != "/":
                    stack.append((len(tokens), x[1:]))
                elif any(label == x[2:] for _, label in stack):
                    while stack.pop()[1] != x[2:]:
                        pass
                tokens.append(x)

    walk(nodes)
    return tokens, slots


def match(wrapper: list, own: list) -> list[int]:
    """For each text slot of a shape the number of its slot in the wrapper, or -1."""
    a, _ = leaves(wrapper)
    b, slots = leaves(own)
    number = lambda tokens: {i: n for n, i in enumerate(i for i, x in enumerate(tokens) if x[0] == "#")}
    left, right = number(a), number(b)
    found = [-1] * len(slots)
    for i, j, n in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
        for k in range(n):
            if j + k in right:
                found[right[j + k]] = left[i + k]
    return found


# ---- What is content. A slot's verdict is "0" for what is none, "1" for content, "2" for content in an article.


def _names(path: tuple) -> list[str]:
    return [label.rstrip("!~") for _, label in path]


def _by_names(path: tuple, trusted: set = frozenset()) -> str:
    """The verdict by names and hints; hints at the places in trusted are wrong."""
    labels = [label.rstrip("!~") if at in trusted else label for at, label in path]
    names = _names(path)
    if any(x in DROPPED for x in names) or any(x.endswith("!") for x in labels):
        return "0"
    if "article" in names or "main" in names:
        return "2"
    return "0" if any(x == "header" or x.endswith("~") for x in labels) else "1"


def decide(wrapper: list, seen: dict[int, tuple], pages: int) -> str:
    """The verdicts of a wrapper's slots; seen: (pages, characters, of them in links, mask of contents, always the same) of each."""
    _, slots = leaves(wrapper)
    none = (0, 0, 0, 0, False)
    facts = [seen.get(i, none) for i in range(len(slots))]
    contents = max((mask.bit_count() for _, _, _, mask, _ in facts), default=0)  # at least so many differ
    if pages < LEAST_PAGES or contents < LEAST_PAGES:
        return "".join(map(_by_names, slots))
    fixed = [same and n == pages for n, _, _, _, same in facts]
    # Text that varies, by element; what HTML itself names as no content is left out.
    varying = [0 if fixed[i] or any(x in DROPPED for x in _names(path)) else facts[i][1] - facts[i][2] for i, path in enumerate(slots)]
    within: dict[int, int] = {}
    for path, chars in zip(slots, varying, strict=True):
        for at, _ in path:
            within[at] = within.get(at, 0) + chars
    trusted = {at for at, chars in within.items() if chars > HINT_SHARE * sum(varying)}
    verdicts = [_by_names(path, trusted) for path in slots]
    if "2" in verdicts:
        article = sum(facts[i][1] for i, v in enumerate(verdicts) if v == "2")
        moving = {at for i, path in enumerate(slots) if facts[i][1] and not facts[i][4] for at, _ in path}
        for i, path in enumerate(slots):
            n, chars, _, _, same = facts[i]
            if verdicts[i] == "2":  # template is a box of its own or links
                standing = same and contents >= LEAST_IN_ARTICLE <= n and 2 * n >= pages and chars <= TEMPLATE_SHARE * article
                boxed = any(name in BOXES and at not in moving for (at, _), name in zip(path, _names(path), strict=True))
                if standing and not _HEADINGS & set(_names(path)) and (boxed or 2 * facts[i][2] > chars):
                    verdicts[i] = "0"
            elif fixed[i]:
                verdicts[i] = "0"
        return "".join(verdicts)
    verdicts = ["0" if fixed[i] else v for i, v in enumerate(verdicts)]
    own = [chars if v != "0" else 0 for chars, v in zip(varying, verdicts, strict=True)]
    region: tuple = ()
    for path in slots:  # the innermost element with nearly all of it
        for k in range(len(path), len(region), -1):
            if sum(c for c, other in zip(own, slots, strict=True) if other[:k] == path[:k]) >= ARTICLE_SHARE * sum(own) > 0:
                region = path[:k]
                break
    first = next((i for i, path in enumerate(slots) if path[: len(region)] == region), 0)
    title = max((i for i in range(first) if verdicts[i] != "0" and "h1" in _names(slots[i])), default=None)
    return "".join(v if i == title or path[: len(region)] == region else "0" for i, (v, path) in enumerate(zip(verdicts, slots, strict=True)))


@lru_cache(maxsize=1 << 14)
def _verdicts(own: str, wrapper: str, verdicts: str) -> str:
    """The verdicts of a shape's slots; names and hints decide for one that the wrapper lacks."""
    nodes = read(own)
    found = match(read(wrapper), nodes) if wrapper else [-1] * own.count("#")
    return "".join(verdicts[j] if j >= 0 else _by_names(path) for j, path in zip(found, leaves(nodes)[1], strict=True))


def main_text(page: str | None, wrapper: str = "", verdicts: str = "") -> str:
    """The texts of a page's content slots; where the page has an article, of those in it."""
    tokens, texts = parsed(page)
    nodes, slots = shape(tokens)
    of: dict[int, str] = {}
    for v, numbers in zip(_verdicts(write(nodes), wrapper, verdicts), slots, strict=True):
        of.update(dict.fromkeys(numbers, v))
    wanted = {"2"} if "2" in of.values() else {"1"}
    blocks: list[list[str]] = []
    new = True
    for token, text, fresh, _ in texts:
        new = new or fresh
        if token >= 0 and of[token] not in wanted or token < 0 and new:
            continue
        if new:
            blocks.append([])
            new = False
        blocks[-1].append(text)
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


_SEEN = "host string, key string, slot int, n long, chars long, links long, mask long, low long, high long"


def observations(pages: DataFrame) -> DataFrame:
    """(host, key, slot, n, chars, links, mask, low, high) of pages (host, html).

    key is a distinct shape; slot -1 counts its pages, and the others sum up what stands in its slots: characters, those in links,
    a mask of 64 bits with one set for each content's hash, and the least and the greatest of these. Rows are combined per task and then by Spark.
    """

    def batches(parts):
        for batch in parts:
            seen: dict[tuple, list] = {}
            for host, page in zip(batch.column("host").to_pylist(), column_texts(batch, "html"), strict=True):
                tokens, texts = parsed(page)
                nodes, slots = shape(tokens)
                key = write(nodes)
                seen.setdefault((host, key, -1), [0, 0, 0, 0, 0, 0])[0] += 1
                at = {token: i for i, numbers in enumerate(slots) for token in numbers}
                words: list[list[str]] = [[] for _ in slots]
                links = [0] * len(slots)
                for token, text, _, linked in texts:
                    if token >= 0:
                        words[at[token]].append(text)
                        if linked:
                            links[at[token]] += len(text)
                for i, own in enumerate(words):
                    text = " ".join("".join(own).split())
                    h = xxhash.xxh64_intdigest(text) >> 1
                    row = seen.get((host, key, i))
                    if row is None:
                        row = seen[host, key, i] = [0, 0, 0, 0, h, h]
                    row[:] = row[0] + 1, row[1] + len(text), row[2] + links[i], row[3] | 1 << h % 64, min(row[4], h), max(row[5], h)
            rows = [(*k, v[0], v[1], v[2], v[3] - (1 << 64) if v[3] >> 63 else v[3], v[4], v[5]) for k, v in seen.items()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "key", "slot", "n", "chars", "links", "mask", "low", "high"])

    return _combined(pages.select("host", "html").mapInArrow(batches, _SEEN), "host", "key", "slot")


def _combined(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n", "chars", "links")), F.expr("bit_or(mask)").alias("mask"), F.min("low").alias("low"), F.max("high").alias("high"))


def inferred(shapes: DataFrame) -> DataFrame:
    """(host, wrapper) from distinct shapes (host, key, n), in rounds of `FAN_IN` shapes a task."""

    def aligned(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["n", "key"], ascending=[False, True])["key"]
        nodes = read(rows.iloc[0])
        for x in rows.iloc[1:]:
            nodes = align(nodes, read(x))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "key": [write(nodes)], "n": [pdf["n"].sum()]})

    while True:
        most = shapes.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return shapes.select("host", F.col("key").alias("wrapper"))
        # Hosts get as many parts as they have shapes for; a part is a pseudo-random choice, about FAN_IN of them.
        sizes = shapes.groupBy("host").agg(F.ceil(F.count("*") / FAN_IN).alias("parts")).withColumnRenamed("host", "of_host")
        dealt = shapes.join(sizes, F.col("host") == F.col("of_host")).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
        shapes = checkpointed(dealt.groupBy("host", "part").applyInPandas(aligned, "host string, key string, n long"))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, verdicts) of each host of pages (host, html)."""
    seen = checkpointed(observations(pages))
    shapes = seen.where("slot < 0").select("host", "key", "n")
    found = inferred(shapes)
    totals = shapes.groupBy("host").agg(F.sum("n").alias("pages")).withColumnRenamed("host", "of_host")
    rules = checkpointed(found.join(totals, F.col("host") == F.col("of_host")).select("of_host", "wrapper", "pages"))

    def matched(parts):
        for batch in parts:
            rows = batch.drop_columns(["key", "wrapper", "slot"])
            slots = [_matched(w, k)[i] for w, k, i in zip(*(batch.column(c).to_pylist() for c in ("wrapper", "key", "slot")), strict=True)]
            yield rows.append_column("slot", pa.array(slots, pa.int32())).filter(pa.array([i >= 0 for i in slots]))

    at_slots = seen.where("slot >= 0").join(_small(rules), F.col("host") == F.col("of_host")).drop("of_host", "pages")
    facts = _combined(at_slots.mapInArrow(matched, "host string, n long, chars long, links long, mask long, low long, high long, slot int"), "host", "slot")
    listed = facts.groupBy("host").agg(F.collect_list(F.struct("slot", "n", "chars", "links", "mask", (F.col("low") == F.col("high")).alias("same"))).alias("facts"))

    def decided(parts):
        for batch in parts:
            out = []
            for w, pages, facts in zip(*(batch.column(c).to_pylist() for c in ("wrapper", "pages", "facts")), strict=True):
                out.append(decide(read(w), {f["slot"]: (f["n"], f["chars"], f["links"], f["mask"] % (1 << 64), f["same"]) for f in facts or ()}, pages))
            yield pa.RecordBatch.from_arrays([batch.column("of_host"), batch.column("wrapper"), pa.array(out, pa.string())], ["host", "wrapper", "verdicts"])

    return rules.join(listed, F.col("of_host") == F.col("host"), "left").select("of_host", "wrapper", "pages", "facts").mapInArrow(decided, "host string, wrapper string, verdicts string")


@lru_cache(maxsize=1 << 14)
def _matched(wrapper: str, own: str) -> list[int]:
    return match(read(wrapper), read(own))


def _small(rules: DataFrame) -> DataFrame:
    """rules, to be sent to all tasks if the wrappers are small enough together."""
    size = rules.agg(F.sum(F.octet_length("wrapper") + 100)).first()[0] or 0
    return F.broadcast(rules) if size <= MOST_BROADCAST else rules


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text) of each row of pages.

    Null and empty pages have an empty text; pages with a null url or one without a host share
    the wrapper of the empty host. Repeated rows are extracted each; of shapes that are as common the
    lesser comes first in an alignment. An empty table gives an empty one.
    """
    named = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.coalesce(F.col(page), F.lit("")).alias("html"))
    rules = _small(checkpointed(wrappers(named).withColumnRenamed("host", "of_host")))
    joined = named.join(rules, named["host"] == F.col("of_host"), "left").select("page_id", "url", "html", "wrapper", "verdicts")

    def batches(parts):
        for batch in parts:
            texts = [main_text(*row) for row in zip(*(column_texts(batch, c) for c in ("html", "wrapper", "verdicts")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = named.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(batches, f"page_id {kind}, url string, text string")
