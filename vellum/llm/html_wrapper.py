"""Main text of web pages by wrappers inferred from pages of the same host.

A page becomes a stream of structural tokens: opening and closing block tags (with class and id), and "#" for a run of
text with whatever inline markup it holds; ends that HTML lets authors leave out are put in. Streams of a host are
aligned one after another into a union-free regular expression: repeats next to each other fold into a repeated group
(...)+, tokens that only some streams have become optional groups (...)?, and text that differs is a slot anyway. All
pages of the host that the wrapper accepts then flag its slots: the content state that at least AGREED of a slot's
occurrences have by their marks (inside <article>, else <main>, else the body, else an <article> inside a box that is
furniture by a word of layout only, and under nothing that is a menu, header, footer, sidebar, notice, advert, form,
script, style or comment section by tag, class or id). On pages with neither <article> nor <main> a slot before the
first or after the last one that varies is template if its text is the same on all these pages, at least
TEMPLATE_PAGES different ones. Inside <article> or <main> nothing is template: the text of such a page doesn't depend
on how many pages lie beside it.

What a mark says: classes that tell what a page has (with-sidebar, has-comments, no-ads, two-column-layout) mark no
furniture; <main> is never furniture by a word and starts content again inside a box that is; an id inside an article
marks furniture only if all its words do (related-posts, not related-work), and ids of headings never; headings inside
an article's header are content, the rest of it isn't. Inline marks never end a block: one is left out only if all its
text is marked. Scripts, styles, buttons, lists to choose from and drawings are no part of the text around them and
don't part it.

A page is read through its host's wrapper: the expression is matched against the page's tokens and the slots flagged as
content give the text. A page that its wrapper doesn't accept (an optional group took what belonged to a later one) has the slots of its
own stream by its own marks, so nothing is lost; so have slots whose marks differ from page to page.

Nothing is sampled: every page's shape goes into its host's wrapper, counts for the flags, and every page is read whole. Pages of one
shape, repeats folded, count once for the wrapper, so what is aligned grows with a host's shapes, not its pages. Nulls: null html is empty and gives an empty text; a null url has the host "".
Repeated rows give repeated results. Empty tables give none. Other columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import takewhile

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut, text_column

#: Fixed by HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr"}), "th": ("td th", {"tr"}), "option": ("option", {"select"})}
#: What isn't main text, by tag and by words of class and id.
ASIDE_TAGS = frozenset("head nav header footer aside form script style noscript template button select textarea iframe object svg canvas dialog menu title".split())
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form gdpr header login masthead menu menubar nav navbar navigation newsletter "
    "notice notices notification popup promo promoted promotion related respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)(>?)""", re.S)
#: Elements whose inside is never shown as text or belongs to a control or drawing.
UNSHOWN = frozenset("script style noscript iframe textarea button select svg canvas".split())
#: A class says what its page has, not what its box is, from one of these words on.
HAS = frozenset("has with without no not hide show".split())
#: Words for places of a page: a box named by nothing else may well hold the article.
PLACES = frozenset("banner footer form header masthead menu menubar nav navbar navigation search sidebar toolbar widget".split())
#: Words that say nothing beside a word of furniture in an id.
FILLERS = frozenset("area article articles bar block bottom box button buttons container content holder inner item items left link links list main module outer page panel post posts right section site slot stories story top unit wrap wrapper zone".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def furniture(kind: str, value: str, inside: bool) -> set[str]:
    """The words of a class or id by which its box is no main text; inside: whether it stands in an article or main."""
    found: set[str] = set()
    for name in value.lower().split():
        words = list(takewhile(lambda w: w not in HAS, re.split(r"[^a-z0-9]+", name)))
        marks = ASIDE_WORDS.intersection(words)
        if "layout" in words or (kind == "id" and inside and not all(w in marks or w in FILLERS or not w or w.isdigit() for w in words)):
            continue
        found |= marks
    return found


class Page:
    """keys: the structural tokens. texts: for each "#" in order, the raw pieces of its text."""

    def __init__(self, source: str):
        self.keys: list[str] = []
        self.texts: list[list[str]] = []
        # of each "#": "a" in an article, "m" in main, "b" elsewhere, "s" in an article in a box named for its place, "-" not content
        self.content: list[str] = []
        # tag, key, state inside: those of content, "-" furniture by tag, "~" by a word, "_" by a word for a place, "^a" or "^m" a header in content
        self.stack: list[tuple[str, str, str]] = []
        self.joined = False  # whether the text that follows belongs to the last "#"
        endless: set[str] = set()  # names without a closing tag from here on
        at = 0
        while m := TAG.search(source, at):
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if not m[4]:  # a quote that never ends, or the end of the page
                end = source.find(">", at)
                at = len(source) if end < 0 else end + 1
                if end < 0:
                    break
            if m[1]:
                self.close(name)
                continue
            if name not in UNSHOWN:
                self.open(name, m[3])
            if name in RAW or (name in UNSHOWN and name not in endless and not m[3].endswith("/")):
                end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(source, at)
                at = end.start() if end else len(source) if name in RAW else at
                if not end:
                    endless.add(name)
        if at < len(source):
            self.text(source[at:])
        while self.stack:
            self.pop()

    def state(self) -> str:
        return self.stack[-1][2] if self.stack else "b"

    def text(self, raw: str) -> None:
        state = self.state() if self.state() in "ambs" else "-"
        if self.joined:
            self.texts[-1].append(raw)
            if self.content[-1] == "-" and not raw.isspace():
                self.content[-1] = state
        elif not raw.isspace():
            self.keys.append("#")
            self.texts.append([raw])
            self.content.append(state)
            self.joined = True

    def inside(self, name: str, named: list[tuple[str, str]]) -> str:
        """The state inside an element."""
        state = self.state()
        main = name != "article" and (name == "main" or ("role", "main") in named)
        if state == "-" or (name in ASIDE_TAGS and name != "header"):
            return "-"
        if main and state != "a":
            return "m"
        if state[0] == "^":
            return state[1:] if name in HEADINGS else "~" if any(furniture(k, v, True) - {"header"} for k, v in named if k != "role") else state
        content = state in ("a", "m")
        kinds = ("class",) if content and name in HEADINGS else ("class", "id")
        words = set() if main or name in ("html", "body") else set().union(*(furniture(k, v, content) for k, v in named if k in kinds))
        if name == "header" or words:
            return "^" + state if content and words <= {"header"} else "-" if name == "header" else "_" if words <= PLACES and state != "~" else "~"
        if name == "article":
            return {"_": "s", "s": "s", "~": "~"}.get(state, "a")
        return state

    def open(self, name: str, attributes: str) -> None:
        marks = ATTRIBUTE.findall(attributes) if "=" in attributes else ()
        named = [(k.lower(), a or b or c) for k, a, b, c in marks]
        if name in INLINE:
            state = self.inside(name, named)
            if name == "br" and self.joined:
                self.texts[-1].append(" ")
            elif name not in VOID and state != self.state():
                self.stack.append((name, "", state))
            return
        self.joined = False
        self.imply(name)
        key = name + "".join(sorted(f".{v.strip()}" for k, v in named if k == "class")) + "".join(f"#{v}" for k, v in named if k == "id" and not re.search(r"\d", v))
        self.keys.append(f"<{key}>")
        if name not in VOID:
            self.stack.append((name, key, self.inside(name, named)))  # after the ends it implies

    def imply(self, name: str) -> None:
        """Ends that may be left out before this tag."""
        if name in CLOSES:
            ends, inside = CLOSES[name]
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in inside:
                    break
                if self.stack[i][0] in ends.split():
                    while len(self.stack) > i:
                        self.pop()
                    break
        elif (at := next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] not in INLINE), -1)) >= 0 and self.stack[at][0] == "p":
            while len(self.stack) > at:
                self.pop()

    def close(self, name: str) -> None:
        if name in UNSHOWN:
            return
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == name), -1)
        if at < 0:
            self.joined &= name in INLINE
            return
        while len(self.stack) > at:
            self.pop()

    def pop(self) -> None:
        _, key, _ = self.stack.pop()
        if key:
            self.joined = False
            self.keys.append(f"</{key}>")


# A wrapper's node: a token, ["?", nodes] or ["+", nodes].


def fold(keys: list) -> list:
    """Repeats of a group next to each other become one repeated group, the shortest groups first, over and over."""
    nodes = list(keys)
    for length in [*range(1, 13), *range(1, 13)]:
        out, i = [], 0
        while i < len(nodes):
            group = nodes[i : i + length]
            j = i + length
            if len(group) == length and group == nodes[j : j + length] and not (length == 1 and (group[0] == "#" or isinstance(group[0], list))):
                while nodes[j : j + length] == group:
                    j += length
                out.append(["+", group])
                i = j
            elif out and isinstance(out[-1], list) and out[-1][0] == "+" and nodes[i : i + len(out[-1][1])] == out[-1][1]:
                i += len(out[-1][1])
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def shape(node) -> str:
    return node if isinstance(node, str) else f"{node[0]}({shape(next((n for n in node[1] if isinstance(n, str)), ''))})"


def generalise(nodes: list) -> list:
    """Groups that were met once only elsewhere as repeated: a group before or after its own repetition joins it."""
    out: list = []
    for node in nodes:
        if out and isinstance(node, list) and node == out[-1]:
            continue
        out.append(node)
    return out


def align(wrapper: list, page: list) -> list:
    """The least union-free expression, of this form, that accepts what either accepts: common tokens stay, groups that repeat
    in either repeat, and what only one has is optional."""
    plus = {shape(n): n for n in [*wrapper, *page] if isinstance(n, list) and n[0] == "+"}
    wrapper, page = (widen(nodes, plus) for nodes in (wrapper, page))
    flat = lambda nodes: [n if isinstance(n, str) else shape(n[1][0]) if n[0] == "?" and len(n[1]) == 1 else shape(n) for n in nodes]
    out: list = []
    for what, i, j, k, m in SequenceMatcher(None, flat(wrapper), flat(page), autojunk=False).get_opcodes():
        if what == "equal":
            for a, b in zip(wrapper[i:j], page[k:m]):
                if isinstance(a, str) and isinstance(b, str):
                    out.append(a)
                elif isinstance(a, list) and isinstance(b, list) and a[0] == b[0] == "+":
                    out.append(["+", align(a[1], b[1])])
                else:
                    out.append(a if isinstance(a, list) and a[0] == "?" else b)
        else:
            out += [optional(n) for n in ([wrapper[i:j]] if j > i else [])]
            out += [optional(n) for n in ([page[k:m]] if m > k else [])]
    return generalise(out)


def widen(nodes: list, plus: dict[str, list]) -> list:
    """Single occurrences of a group that repeats elsewhere become that group."""
    out, i = [], 0
    while i < len(nodes):
        for group in plus.values():
            body = group[1]
            if nodes[i : i + len(body)] == body:
                while nodes[i : i + len(body)] == body:
                    i += len(body)
                out.append(group)
                break
        else:
            out.append(nodes[i])
            i += 1
    return out


def optional(nodes: list):
    return nodes[0] if len(nodes) == 1 and isinstance(nodes[0], list) and nodes[0][0] == "?" else ["?", nodes]


def infer(expressions: list[list]) -> list:
    """One expression for all of them, the longest first."""
    wrapper: list | None = None
    for text in sorted({json.dumps(e) for e in expressions}, key=lambda t: (-len(t), t)):
        wrapper = json.loads(text) if wrapper is None else align(wrapper, json.loads(text))
    return wrapper or []


class Wrapper:
    """A union-free expression, matched token by token, with its slots numbered in order and the learnt flag of each."""

    def __init__(self, nodes: list, flags: str = ""):
        self.flags = flags
        self.n_slots = 0
        self.nodes = self.number(nodes)

    def number(self, nodes: list) -> list:
        out: list = []
        for n in nodes:
            if n == "#":
                out.append(self.n_slots)
                self.n_slots += 1
            else:
                out.append(n if isinstance(n, str) else (n[0], self.number(n[1])))
        return out

    def match(self, keys: list[str]) -> list[int] | None:
        """The slot of each "#" of a page, or None if the page isn't accepted. Groups begin with their own token, so nothing
        is gained by giving back what one took."""
        found: list[int] = []
        return found if self.follow(self.nodes, keys, 0, found) == len(keys) else None

    def follow(self, nodes: list, keys: list[str], at: int, found: list[int]) -> int:
        """The place after the nodes, or -1."""
        for n in nodes:
            if isinstance(n, tuple):
                times = 0
                while times == 0 or n[0] == "+":
                    mark = len(found)
                    after = self.follow(n[1], keys, at, found)
                    if after < 0:
                        del found[mark:]
                        break
                    times += 1
                    if after == at:
                        break
                    at = after
                if n[0] == "+" and not times:
                    return -1
            elif at < len(keys) and keys[at] == ("#" if isinstance(n, int) else n):
                if isinstance(n, int):
                    found.append(n)
                at += 1
            else:
                return -1
        return at


#: A slot is part of the template if its text is the same on all of a host's pages, at least this many different ones (told
#: apart by 63 hash bits, so that a few more may be needed).
TEMPLATE_PAGES = 8
#: A slot has the content state that this share of its occurrences on the host have; else each page's own holds.
AGREED = 0.9


def read_slots(page: Page, slots: list[int] | None = None, flags: str = "") -> str:
    """The text of the content slots, a block a slot: those of the wrapper's flags ("a", "m", "b", "s" or "-", "t" for template and
    "?" for the page's own state), or without a match those of the page's own states."""
    states = page.content if slots is None else [own if flags[s] == "?" else flags[s] for s, own in zip(slots, page.content)]
    level = next((x for x in "ambs" if x in states), "b")
    blocks = (" ".join(html.unescape("".join(t)).split()) for t, c in zip(page.texts, states) if c == level)
    return "\n\n".join(b for b in blocks if b)


def flag(own: dict[str, int]) -> str:
    """A slot's flag from how often it had each state."""
    state = max("ambs-", key=lambda x: own[x])
    return state if own[state] >= AGREED * sum(own.values()) else "?"


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


#: Expressions that a task aligns at once, about. A host with more shapes has them aligned in parts, and its wrapper accepts fewer
#: of them: what is optional in two parts by different groups isn't told to be the same.
ALIGNED = 1_000


def shapes(pages: DataFrame) -> DataFrame:
    """host, h, nodes: each folded stream that any of a host's pages has, once (JSON), and a hash by which they are dealt."""

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            met = {(host_of(url), json.dumps(Page(source).keys)) for _, url, source in zip(*(b.column(i).to_pylist() for i in range(3)))}
            rows = sorted({(host, json.dumps(fold(json.loads(keys)))) for host, keys in met})
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["host", "nodes"])

    return pages.mapInArrow(streams, "host string, nodes string").distinct().withColumn("h", F.xxhash64("nodes"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON): one expression of all shapes of all a host's pages. Shapes are aligned about ALIGNED at a time, and
    what comes of them likewise until a host has one, so that no task meets many more at once; how they are dealt goes
    by their hashes, so the result doesn't depend on partitions."""

    def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], json.dumps(infer([json.loads(s) for s in rows["nodes"]])))], columns=["host", "nodes"])

    now = cut(shapes(pages))
    while (most := now.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        deal = F.pmod("h", F.lit(-(-most // ALIGNED)))
        now = cut(now.groupBy("host", deal.alias("deal")).applyInPandas(learn, "host string, nodes string").withColumn("h", F.xxhash64("nodes")))
    return now.select("host", F.col("nodes").alias("wrapper"))


def with_wrappers(raw: DataFrame, learnt: DataFrame, salts: int) -> DataFrame:
    """The pages with their host's wrapper, each copied to `salts` places so that a host with a third of all pages is dealt out."""
    host = F.udf(host_of, "string")
    salted = raw.withColumn("host", host("url")).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)))
    copies = learnt.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return salted.join(copies, ["host", "salt"], "left").select("page_id", "url", "html", "wrapper")


def slot_flags(pages: DataFrame, known: dict[str, str] | None) -> DataFrame:
    """host, flags: one letter a slot of the host's wrapper, from all its pages that the wrapper accepts. Each batch gives
    one row a slot, whatever the number of pages; rows of a slot are summed before those of a host come together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[str, Wrapper] = {}
        for b in batches:
            slots: dict[tuple[str, int], dict] = {}
            sizes: dict[str, int] = {}
            for _, url, source, w in rows_of(b, known):
                if w is None:
                    continue
                host, page = host_of(url), Page(source)
                wrapper = compiled_wrapper(compiled, w)
                found = wrapper.match(page.keys)
                if found is None:
                    continue
                sizes[host] = wrapper.n_slots
                texts: dict[int, str] = {}
                for s, t in zip(found, page.texts):
                    texts[s] = texts.get(s, "") + " ".join("".join(t).split()) + "\n"
                digest = xxhash.xxh64_intdigest("\0".join(texts.values())) >> 1
                for s, own in zip(found, page.content):
                    kept = slots.setdefault((host, s), {"a": 0, "m": 0, "b": 0, "s": 0, "-": 0, "lo": None, "hi": None, "pages": 0})
                    kept[own] += 1
                    if s in texts:
                        h = xxhash.xxh64_intdigest(texts.pop(s)) >> 1
                        kept["lo"], kept["hi"] = (h, h) if kept["lo"] is None else (min(kept["lo"], h), max(kept["hi"], h))
                        kept["pages"] |= 1 << digest % 63
            out = [(host, s, sizes[host], k["a"], k["m"], k["b"], k["s"], k["-"], k["lo"], k["hi"], k["pages"]) for (host, s), k in slots.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if i else pa.string()) for i in range(len(names))], names=names)

    names = ["host", "slot", "n_slots", "a", "m", "b", "s", "aside", "lo", "hi", "pages"]
    counts = pages.mapInArrow(count, "host string, " + ", ".join(f"{n} bigint" for n in names[1:]))
    sums = [F.sum(n).alias(n) for n in names[3:8]]
    slots = counts.groupBy("host", "slot").agg(F.max("n_slots").alias("n_slots"), *sums, F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bit_or("pages").alias("pages"))

    def decide(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        flags = ["?"] * int(rows["n_slots"].max())
        same, varying = [], []
        for r in rows.to_dict("records"):
            flags[r["slot"]] = flag({"a": r["a"], "m": r["m"], "b": r["b"], "s": r["s"], "-": r["aside"]})
            if r["lo"] == r["hi"] and int(r["pages"]).bit_count() >= TEMPLATE_PAGES:
                same.append(r["slot"])
            elif flags[r["slot"]] != "-":
                varying.append(r["slot"])
        # where nothing of the content varies, the pages are copies and show no template
        for s in same if varying else ():
            if flags[s] == "b" and not min(varying) < s < max(varying):
                flags[s] = "t"
        return pd.DataFrame([(key[0], "".join(flags))], columns=["host", "flags"])

    return slots.groupBy("host").applyInPandas(decide, "host string, flags string")


def rows_of(b: pa.RecordBatch, known: dict[str, str] | None) -> Iterator[tuple]:
    """page_id, url, html and wrapper of a batch's pages; the wrapper from `known` or else the fourth column."""
    ids, urls, sources = (b.column(i).to_pylist() for i in range(3))
    given = b.column(3).to_pylist() if known is None else [known.get(host_of(u)) for u in urls]
    return zip(ids, urls, sources, given)


def compiled_wrapper(compiled: dict[str, Wrapper], w: str) -> Wrapper:
    if w not in compiled:
        if len(compiled) > 5000:
            compiled.clear()
        compiled[w] = Wrapper(*json.loads(w))
    return compiled[w]


def extract(pages: DataFrame, closure_bytes: int = 32 << 20, salts: int = 64) -> DataFrame:
    """page_id, url, text, n_chars, by_wrapper (whether the host's wrapper accepts the page and so gives its text).

    The wrappers go with the code if they take at most closure_bytes; else they are joined by host."""
    raw = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), text_column("html").alias("html"))
    learnt = cut(wrappers(raw).select("host", F.concat(F.lit("["), "wrapper", F.lit("]")).alias("wrapper")))
    small = (learnt.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0) <= closure_bytes
    first = {r["host"]: r["wrapper"] for r in learnt.collect()} if small else None
    flags = slot_flags(raw if small else with_wrappers(raw, learnt, salts), first)
    # a host none of whose pages is accepted has no flags and needs none
    learnt = cut(learnt.join(flags, "host").select("host", F.concat(F.expr("left(wrapper, length(wrapper) - 1)"), F.lit(', "'), "flags", F.lit('"]')).alias("wrapper")))
    known = {r["host"]: r["wrapper"] for r in learnt.collect()} if small else None
    out = "page_id bigint, url string, text string, n_chars bigint, by_wrapper boolean"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[str, Wrapper] = {}
        for b in batches:
            texts, through = [], []
            for _, _, source, w in rows_of(b, known):
                page = Page(source)
                wrapper = None if w is None else compiled_wrapper(compiled, w)
                slots = wrapper.match(page.keys) if wrapper else None
                through.append(slots is not None)
                texts.append(read_slots(page) if slots is None else read_slots(page, slots, wrapper.flags))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(through, pa.bool_())], names=["page_id", "url", "text", "n_chars", "by_wrapper"]
            )

    return (raw if small else with_wrappers(raw, learnt, salts)).mapInArrow(read, out)
