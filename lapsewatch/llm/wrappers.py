"""Main text of web pages by wrappers: union-free expressions inferred from pages of one host.

A page becomes a tree of its block elements. The children of an element are a sequence in which
tandem repeats fold into repeated groups. Two pages of a host align element by element: what both
have is merged, a mismatch next to an equal group becomes a repetition, any other one an optional
group. Texts align with their elements: equal ones are template text, others a slot; of a repeated
group the first and the last element are told apart. Aligning goes on page by page within a batch,
then wrapper by wrapper in a tree of fixed fan-in, so the pages of a hot host never meet in one task.

The finished wrapper decides three things. The path of the element that holds the main text. The
template texts below it: what pages of at least four different articles all say at the same place
is left out, a heading only if its parent holds no slot. And elements that class or id would drop: one
whose slots hold more than twice the rest of the main text stays. Apart from these, the text below the path is taken
without the parts that are menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles or comments by element, role, class or id; a paragraph, heading or list item goes only if all
its classes say so. A page that lacks the path is its own wrapper. Equal pages count as one article,
so the text of a host of copies is no template.

Blocks are the text between block elements, white space in them is one space, character
references are decoded once, and blocks are joined by an empty line. A null, empty or textless
page has an empty text. A null or odd address counts as a host of its own name. Repeated rows stay.
Only the named columns are read.
"""

from __future__ import annotations

import html
import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b
from heapq import nlargest

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewatch.llm.common import by_batch, partitions, pieces_of, written

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*+)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+(?:>|$)|<[!?/][^>]*+(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[a-zA-Z]+")
NUMBER = re.compile(r"\d.*")

# Pages nest without bound, and so do wrappers; calls between Python functions take no C stack.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000_000))

# Fixed names of elements.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCKS - {"body", "head", "html", "option", "legend", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article aside body div dl fieldset footer form header html main nav ol section table td th ul".split())
DROPPED = RAW | frozenset("nav header footer aside form head button select dialog menu "
                          "input label fieldset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
# Fixed words of classes and ids.
DROP_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription "
    "sidebar sidebox menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments "
    "commentlist respond disqus reply replies share sharing social related recommended recommendations "
    "toolbar widget pagination pager login signin signup register copyright disclaimer skip hidden "
    "tags tagcloud byline-ad".split())
# Words that say where an element is or how it looks; beside a word above they leave its meaning.
PLAIN_WORDS = frozenset(
    "site page blog global primary secondary top bottom left right center upper lower first last inner outer "
    "main content post entry article body wrapper wrap container box bar list links items item area block slot "
    "section region group panel form unit zone message posts stories articles icons buttons bar dark light "
    "small large mobile desktop fixed sticky title".split())
OTHERS_WORDS = frozenset("ad ads advert advertisement sponsored comment comments".split())
MAIN_WORDS = frozenset("article content main post entry story articlebody maintext".split())
# A class of readers' comments, but as an id often a chapter.
CLASS_WORDS = frozenset(["discussion"])
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Different articles that must say the same at the same place to make it template text.
ARTICLES = 4
#: Wrappers that meet in one group when a host's wrappers are joined.
FAN = 16
#: What ``first`` and ``last`` of a part are once pages differ there.
SLOT = -1


@dataclass
class Node:
    """An element with its children in order; texts are (in a link, text) pairs among them."""

    key: str
    kind: str = "body"  # body, main, article, content, dropped, doubtful (dropped by class or id)
    items: list = field(default_factory=list)

    def text(self) -> str:
        """Its own text, without that of the block elements in it."""
        found = "".join([item[1] for item in self.items if isinstance(item, tuple)])
        return SPACE.sub(" ", html.unescape(found)).strip() if found else ""


def hashed(text: str) -> int:
    """48 bits for a text, 0 for none."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).digest()) if text else 0


def tokens_of(label: str) -> list[set[str]]:
    """The words of each class or id, without numbers."""
    found = (({NUMBER.sub("", w) for w in re.split(r"[^a-z0-9]+", token)} - {""}) for token in label.lower().split())
    return [words for words in found if words]


def describe(tag: str, rest: str) -> tuple[str, str]:
    """Name of the element for alignment, and what it is."""
    if not rest or rest == "/":
        words, classes, tokens, role, hidden = set(), [], [], "", False
        key = tag
    else:
        named = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(rest)}
        classes = tokens_of(named.get("class", ""))
        words = {w.lower() for w in NAME.findall(f"{named.get('class', '')} {named.get('id', '')}")}
        tokens = classes + tokens_of(named.get("id", ""))
        role = named.get("role", "").lower()
        hidden = (re.search(r"(?<![\w-])hidden(?![\w=-])", rest) is not None
                  or named.get("aria-hidden") == "true"
                  or "display:none" in named.get("style", "").replace(" ", "").lower())
        key = tag + ("." + ".".join(sorted(words)) if words else "")
    if tag in DROPPED or role in ROLES or hidden:
        return key, "dropped"
    # A class says what is dropped only as a whole: no-sidebar and comments-open do not.
    drops = [t for t in tokens if t & DROP_WORDS and t <= DROP_WORDS | PLAIN_WORDS]
    if tag in TEXTS and not all(t <= DROP_WORDS | PLAIN_WORDS for t in tokens):
        drops = []
    comments = [t for t in classes if t & CLASS_WORDS and t <= CLASS_WORDS | PLAIN_WORDS]
    drops, others = drops + comments, bool(comments) or any(t & OTHERS_WORDS for t in drops)
    if tag == "article":
        return key, "dropped" if others else "article"
    if tag == "main" or role == "main":
        return key, "main"
    if tag not in ("body", "html"):
        if not others and any(t <= MAIN_WORDS for t in tokens):
            return key, "content"
        if drops:
            return key, "dropped"
        if words & MAIN_WORDS:
            return key, "content"
    return key, "body"


def by_class(tag: str, rest: str) -> bool:
    """Whether a dropped element would stay but for its class and id."""
    others = ATTRIBUTE.sub(lambda m: "" if m[1].lower() in ("class", "id") else m[0], rest)
    return describe(tag, others)[1] != "dropped"


def parse(page: str) -> Node:
    """The page as a tree of block elements; inline elements only mark links and dropped text."""
    root = Node("")
    stack: list[tuple[str, Node]] = [("", root)]
    at, links, muted = 0, 0, []  # muted: open inline elements whose text does not count
    unsure: dict[int, Node] = {}  # elements dropped by class or id

    def text(until: int) -> None:
        if until > at and not muted:
            stack[-1][1].items.append((links > 0, page[at:until]))

    def close(tag: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return
            if tag not in SCOPES and stack[i][0] in SCOPES:
                return

    token = TOKEN.search(page)
    while token:
        text(token.start())
        at = token.end()
        tag, closing = (token["tag"] or "").lower(), token["close"]
        if tag in RAW and not closing:
            if not token["rest"].endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif tag == "br":
            if not muted:
                stack[-1][1].items.append((False, " "))
        elif tag in BLOCKS:
            muted = [] if closing else muted
            if closing:
                links = 0
                close(tag)
            else:
                if tag in ENDS_P:
                    close("p")
                for other in SAME.get(tag, ()):
                    close(other)
                if tag in ("html", "body") and any(s[0] == tag for s in stack):
                    token = TOKEN.search(page, at)
                    continue
                node = Node(*describe(tag, token["rest"]))
                stack[-1][1].items.append(node)
                if node.kind == "dropped" and tag != "article" and by_class(tag, token["rest"]):
                    unsure[id(node)] = node
                if tag not in VOID:
                    stack.append((tag, node))
        elif tag == "a":
            links = 0 if closing else 1
        elif tag and tag not in VOID:
            if closing:
                if tag in muted:
                    muted.remove(tag)
            elif describe(tag, token["rest"])[1] == "dropped" and not token["rest"].endswith("/"):
                muted.append(tag)
        token = TOKEN.search(page, at)
    text(len(page))
    if unsure:
        _keep_main(root, unsure)
        for node in unsure.values():
            if node.kind == "dropped" and not set(node.key.split(".")[1:]) & (OTHERS_WORDS | CLASS_WORDS):
                node.kind = "doubtful"
    return root


def _keep_main(root: Node, unsure: dict[int, Node]) -> None:
    """If the page's articles and main elements are all in elements dropped by class, those stay."""
    kept: set[int] = set()

    def inside(start: Node, through: bool) -> bool:
        stack = [start]
        while stack:
            node = stack.pop()
            if node.kind in ("article", "main") or id(node) in kept:
                return True
            if node.kind != "dropped" or node is start or (through and id(node) in unsure):
                stack += [item for item in node.items if isinstance(item, Node)]
        return False

    if not inside(root, False) and inside(root, True):
        # Inner elements come last and are looked at first, so no part of the page is walked twice.
        for node in reversed(unsure.values()):
            if inside(node, False):
                node.kind = "body"
                kept.add(id(node))


# --- expressions ---------------------------------------------------------------------------------

@dataclass
class Part:
    """A group of a wrapper: an element, how often it may come, and its text.

    ``first`` and ``last`` are the hash of the text of its first and last element, or SLOT where
    pages differ; ``seen`` the least ARTICLES of the articles it came with, while one of both holds.
    """

    key: str
    kind: str
    pages: int
    chars: int
    optional: bool = False
    repeated: bool = False
    first: int = 0
    last: int = 0
    seen: list = field(default_factory=list)
    parts: list = field(default_factory=list)

    def template(self) -> set[int]:
        """Hashes of the texts that enough different articles share here."""
        return {self.first, self.last} - {0, SLOT} if len(self.seen) >= ARTICLES else set()

    def pattern(self) -> str:
        inner = " ".join([p.pattern() for p in self.parts])
        slot = "#" if self.chars else ""
        whole = f"<{self.key}>{slot}{inner}" if self.key != "()" else inner
        mark = "+" if self.repeated else ""
        return f"({whole}){mark}{'?' if self.optional else ''}" if mark or self.optional else whole

    def pack(self) -> list:
        """The parts in page order, each with how many it holds; flat, as depth has no bound."""
        out, stack = [], [self]
        while stack:
            part = stack.pop()
            out.append([part.key, part.kind, part.pages, part.chars, part.optional, part.repeated,
                        part.first, part.last, part.seen, len(part.parts)])
            stack += reversed(part.parts)
        return out

    @staticmethod
    def unpack(held: list) -> Part:
        done: list[Part] = []
        for *values, count in reversed(held):
            parts = [done.pop() for _ in range(count)]
            done.append(Part(*values, parts))
        return done[0]


def identity(part: Part) -> str:
    """What must agree for two parts to align: the element, or the elements of a group."""
    return part.key if part.key != "()" else "(" + " ".join(identity(p) for p in part.parts) + ")"


def fold(parts: list[Part]) -> list[Part]:
    """Tandem repeats of one to four parts become one repeated group."""
    for width in range(1, 5):
        out: list[Part] = []
        for part in parts:
            out.append(part)
            # A repeated single part followed by itself, or a group followed by its elements.
            if width == 1:
                if len(out) > 1 and identity(out[-2]) == identity(part):
                    out[-2:] = [join(out[-2], part, same_page=True)]
                    out[-1].repeated = True
                continue
            tail = out[-width:]
            if len(out) > width and out[-width - 1].key == "()" and len(tail) == width and [
                    identity(p) for p in out[-width - 1].parts] == [identity(p) for p in tail]:
                group = out[-width - 1]
                group.parts = [join(a, b, same_page=True) for a, b in zip(group.parts, tail)]
                del out[-width:]
            elif len(out) >= 2 * width and [identity(p) for p in out[-2 * width:-width]] == [
                    identity(p) for p in tail]:
                both = [join(a, b, same_page=True) for a, b in zip(out[-2 * width:-width], tail)]
                out[-2 * width:] = [Part("()", "body", both[0].pages, 0, False, True, parts=both)]
        parts = out
    return parts


def join(a: Part, b: Part, same_page: bool = False) -> Part:
    """The wrapper of what two aligned parts cover."""
    if same_page:
        pages, first, last, seen = max(a.pages, b.pages), a.first, b.last, a.seen
    else:
        pages = a.pages + b.pages
        first = a.first if a.first == b.first else SLOT
        last = a.last if a.last == b.last else SLOT
        seen = sorted({*a.seen, *b.seen})[:ARTICLES] if (first, last) != (SLOT, SLOT) else []
    # A doubtful element that some page keeps, as its whole article is in it, is kept for the host.
    kind = b.kind if a.kind == "doubtful" else a.kind
    return Part(a.key, kind, pages, a.chars + b.chars, a.optional or b.optional,
                a.repeated or b.repeated, first, last, seen, align(a.parts, b.parts, same_page))


def align(a: list[Part], b: list[Part], same_page: bool = False) -> list[Part]:
    """Two sequences as one: equal parts merge, mismatches become repetitions or options."""
    names_a, names_b = [identity(p) for p in a], [identity(p) for p in b]
    if names_a == names_b:
        return [join(x, y, same_page) for x, y in zip(a, b)]
    out: list[Part] = []
    for what, i, j, k, m in SequenceMatcher(None, names_a, names_b, autojunk=False).get_opcodes():
        if what == "equal":
            out += [join(x, y, same_page) for x, y in zip(a[i:j], b[k:m])]
            continue
        for part in (*a[i:j], *b[k:m]):
            if out and identity(out[-1]) == identity(part):
                out[-1] = join(out[-1], part, same_page)
                out[-1].repeated = True
            else:
                part.optional = True
                out.append(part)
    return out


def expression(node: Node, article: int | None = None) -> Part:
    """A page as a wrapper of itself. Its two longest texts stand for its article."""
    if article is None:
        longest, stack = [], [node]
        while stack:
            top = stack.pop()
            longest = nlargest(2, {*longest, top.text()}, key=lambda t: (len(t), t))
            stack += [item for item in top.items if isinstance(item, Node) and item.kind != "dropped"]
        article = hashed("\n".join(longest))
    parts = [expression(item, article) for item in node.items if isinstance(item, Node)]
    chars = sum([len(item[1]) for item in node.items if isinstance(item, tuple) and not item[0]])
    own = hashed(node.text())
    return Part(node.key, node.kind, 1, chars, first=own, last=own, seen=[article], parts=fold(parts))


def main_path(wrapper: Part) -> str:
    """Path of the element with the main text: the best article, else main, else content, else all.

    Of several of a kind the one with most text counts, dropped parts left out.
    """
    best: dict[str, tuple[int, str]] = {}

    def walk(part: Part, path: str) -> int:
        if part.kind in ("dropped", "doubtful"):
            return 0
        here = path if part.key == "()" else f"{path}/{part.key}"
        chars = part.chars
        for p in part.parts:
            chars += walk(p, here)
        if part.kind in ("article", "main", "content"):
            old = best.get(part.kind)
            if old is None or chars > old[0]:
                best[part.kind] = (chars, here)
        return chars

    total = walk(wrapper, "")
    for kind in ("article", "main", "content"):
        if kind in best and best[kind][0] * 4 >= total:
            return best[kind][1]
    return ""


def decisions(wrapper: Part) -> dict:
    """What the wrapper decides: path of the main text, template texts by path, doubtful paths that stay."""
    main = main_path(wrapper)
    template: dict[str, set[int]] = {}
    doubtful: dict[str, int] = {}
    sure = 0

    def walk(part: Part, path: str, inside: bool, doubt: str) -> tuple[bool, list]:
        """Whether there is a slot in the part, and its headings that are template text."""
        nonlocal sure
        group = part.key == "()"
        here = path if group else f"{path}/{part.key}"
        inside = inside or here == main
        if part.kind == "dropped":
            return False, []
        if part.kind == "doubtful" and inside and not doubt:
            doubt = here
        if inside and doubt:
            doubtful[doubt] = doubtful.get(doubt, 0) + (part.chars if SLOT in (part.first, part.last) else 0)
        elif inside:
            sure += part.chars
        slot, headings = SLOT in (part.first, part.last), []
        for inner in part.parts:
            some, names = walk(inner, here, inside, doubt)
            slot = slot or some
            headings += names
        same = part.template() if inside else set()
        if same and part.key.split(".")[0] in HEADINGS:
            return slot, [*headings, (here, same)]
        if same:
            template.setdefault(here, set()).update(same)
        if slot and not group:
            headings = []
        elif not group:
            for name, texts in headings:
                template.setdefault(name, set()).update(texts)
            headings = []
        return slot, headings

    varies, _ = walk(wrapper, "", not main, "")
    most = max(doubtful, key=doubtful.get, default="")
    keep = [most] if most and doubtful[most] > 2 * sure else []
    return {"path": main, "template": {k: sorted(v) for k, v in template.items()} if varies else {}, "keep": keep}


@lru_cache(maxsize=64)
def _read(held: str) -> dict:
    return json.loads(held)


def blocks(node: Node, decided: dict) -> list[str] | None:
    """Texts of the blocks below every element at the path, in page order; None if there is none."""
    path, template, keep = decided["path"], decided["template"], set(decided["keep"])
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            whole = SPACE.sub(" ", html.unescape("".join(run))).strip()
            if whole:
                out.append(whole)
            run.clear()

    def quiet(at: Node, here: str) -> bool:
        return here in template and hashed(at.text()) in template[here]

    # Explicit stack: pages may nest without bound. Entries: (node, path, inside, next item, quiet).
    stack = [[node, "/" + node.key, not path, 0, not path and quiet(node, "/" + node.key)]]
    found = not path
    while stack:
        top = stack[-1]
        current, here, inside, i, still = top
        if i == len(current.items):
            if inside:
                flush()
            stack.pop()
            continue
        top[3] += 1
        item = current.items[i]
        if isinstance(item, tuple):
            if inside and not still:
                run.append(item[1])
        elif item.kind != "dropped":
            below = f"{here}/{item.key}"
            if item.kind == "doubtful" and below not in keep:
                continue
            if inside:
                flush()
            enters = inside or below == path
            found = found or enters
            stack.append([item, below, enters, 0, enters and quiet(item, below)])
    return out if found else None


def extract(page: str | None, decided: str | None) -> str:
    """The main text of a page by its host's wrapper, or by its own if it lacks the path."""
    if not page:
        return ""
    tree = parse(page)
    found = blocks(tree, _read(decided)) if decided is not None else None
    if found is None:
        found = blocks(tree, decisions(expression(tree))) or []
    return "\n\n".join(found)


# --- Spark ---------------------------------------------------------------------------------------

def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _merged(packed: Iterator[str]) -> str:
    whole = None
    for held in packed:
        part = Part.unpack(json.loads(held))
        whole = part if whole is None else join(whole, part)
    return json.dumps(whole.pack())


def wrappers(pages: DataFrame, html_column: str = "html", host: str = "host") -> DataFrame:
    """host, wrapper (packed), expression and decisions: one row per host.

    Pages align within their batch first; then at most one wrapper a host and batch moves on,
    joined in salted groups, each level FAN of the groups before, until one is left.
    """
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[str, Part] = {}
        for piece in pieces_of(batch):
            for name, page in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                if page:
                    part = expression(parse(page))
                    found[name] = join(found[name], part) if name in found else part
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()),
             pa.array([json.dumps(p.pack()) for p in found.values()], pa.string())],
            ["host", "wrapper"])

    rows = by_batch(pages.select(F.col(host).alias("host"), F.col(html_column).alias("html")), work,
                    "host string, wrapper string")
    salts = max(2, partitions(pages.sparkSession))
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)).cast("int"))

    def join_rows(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [_merged(frame["wrapper"])],
                             "salt": [frame["salt"].iloc[0]]})

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        held = _merged(frame["wrapper"])
        whole = Part.unpack(json.loads(held))
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [held],
                             "expression": [whole.pattern()], "decided": [json.dumps(decisions(whole))]})

    while True:
        joined = joined.groupBy("host", "salt").applyInPandas(join_rows, "host string, wrapper string, salt int")
        if salts <= FAN:
            break
        salts = -(-salts // FAN)
        joined = joined.withColumn("salt", F.col("salt") % salts)
    return joined.groupBy("host").applyInPandas(
        finish, "host string, wrapper string, expression string, decided string")


def main_text(df: DataFrame, key: str, url: str, html_column: str) -> DataFrame:
    """key, url and text of every page."""
    pages = df.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html_column).alias("html"),
                      host_of(F.col(url)).alias("host"))
    decided = written(wrappers(pages).select("host", "decided"), "wrappers")
    kind = df.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for piece in pieces_of(batch):
            texts += [extract(page, held) for page, held in
                      zip(piece.column(2).to_pylist(), piece.column(3).to_pylist())]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["key", "url", "text"])

    joined = pages.join(decided, "host", "left").select("key", "url", "html", "decided")
    return by_batch(joined, work, f"key {kind}, url string, text string").withColumnRenamed("key", key)
