"""Main text of web pages, by template deduction from equivalence classes of tokens.

A page's tokens are its elements, each named by its path of tags with their classes and ids, and its texts, each named by
the path and the text. Over the pages of one host every token has an occurrence vector: how often it occurs on each page.
Tokens with equal vectors form a class; vectors are compared by fingerprints (sums and exclusive ors of hashes of page
and count) that merge by aggregation, so no host's pages meet in one task.

A class is a part of the template if its tokens occur once on each of their pages, and either on all pages of the host
(the root class) or on at least ``SAME_PAGES`` (a layout of some pages). Classes are nested by their paths: an element
whose parent is no part of the template isn't either. On each page the tokens have to come in the order that they have
over the whole host; one out of order is content there.

The template's elements are slots. What the host's pages say in a slot outside of links, but for constant text, is its
mass. From the root on, a page's main slot is the one inside that has ``DOMINANT`` of the mass, and so on until none has.
What lies in the main slot is the article, but for inner slots that are constant or mostly links, texts of the root
class (where no element says that it is the article), and what says by its element or marks that it is none (navigation, notice, advert, form, comments, ...). Of what
lies around the main slot, outside of other slots, its headline stays, and texts if they have a large mass.

Words of classes and ids choose no text: they only keep slots from being the main one, and, inside of it, rule out slots
of the template and elements with a telling class as a whole. An ``article`` or ``main`` counts ``MAIN_WEIGHT`` times in the
choice. A host with one or two pages, or with copies of them, has a template too, of the tokens that occur once on each; it
shows no constant texts and no layouts, so there mass, links, elements and marks decide alone.

Edge cases: null or empty html gives the empty text and is no page of a template, as are pages without elements; a null
url is a host of its own; a page without tags is one block; truncated pages give what they hold; repeated rows give
repeated rows, and are one content; constant text is only known from ``SAME_PAGES`` pages of different content on, and only
if it is the lesser part of what the main slot holds; an empty table gives an empty result; further columns are ignored;
texts are taken whole.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Templates are sent to all tasks up to this many bytes. Beyond, the pages of a host are joined with its template in parts
#: of about PAGES; hosts with more are listed, and the list is broadcast, up to FEW_HOSTS of them.
FEW_BYTES, PAGES, FEW_HOSTS = 50_000_000, 1_000, 100_000
#: A slot with this share of the mass around it is the main one.
DOMINANT = 0.6
#: How often the mass of an ``article`` or ``main`` counts in that choice.
MAIN_WEIGHT = 3
#: Texts around the main slot stay from this share of its mass on.
BESIDE = 0.25
#: From this share of linked text on, a slot is a menu.
LINKED = 0.6
#: Pages of different content that show that a text is constant, and pages that make a layout.
SAME_PAGES = 3

_TOKENS = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?[A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|$)", re.S)
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_ATTRIBUTES = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[A-Za-z]+")

#: Element names of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption head title".split()
)
CLOSES_P = BLOCKS - frozenset(("option", "optgroup", "body", "html", "head", "title", "caption", "tbody", "thead", "tfoot", "tr", "li", "dd", "dt"))
DROPPED_TAGS = frozenset("nav header footer aside form script style noscript template head title button select textarea svg iframe menu dialog object canvas math audio video map option".split())
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr "
    "notice banner popup modal overlay newsletter subscribe signup login search form comment comments disqus replies respond breadcrumb breadcrumbs pagination pager "
    "share sharing social related recommended widget toolbar skip copyright contentinfo complementary alert hidden".split()
)
#: Whole class names, roles and ids of containers that are no part of an article that they lie in.
DROPPED_IN_MAIN = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs pagination sidebar aside complementary ad ads advert advertisement comments comment-list disqus disqus_thread "
    "respond replies hidden".split()
)
#: Elements that hold text themselves; single words of their marks and their ids (targets of links) say nothing.
TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd blockquote pre figure figcaption td th caption summary".split())
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset(("article", "main"))


class Block:
    """A piece of text between block borders, with its path and how much of it is in links."""

    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


@lru_cache(100_000)
def _step(tag: str, name: str) -> str:
    """The step of a path for a start tag: its name, with the words of class, role and, after a #, id."""
    if len(tag) == len(name) + 2:
        return name
    words, seen = [], set()
    for key, a, b, c in _ATTRIBUTES.findall(tag, len(name) + 1):
        key, value = key.lower(), a or b or c
        if key in seen:
            continue
        seen.add(key)
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
            words.append("hidden")
        elif key in ("class", "role"):
            words += value.lower().split()
        elif key == "id":
            words += ["#" + w for w in value.lower().split()]
    return name + "".join(f".{w}" for w in sorted(set(words)))


def parse(page: str | None) -> tuple[list[tuple[str, ...]], list[Block]]:
    """The paths of a page's elements in page order, and its blocks of text."""
    page = page or ""
    stack: list[tuple[str, str]] = []
    paths: list[tuple[str, ...]] = []
    blocks: list[Block] = []
    text: list[tuple[str, bool]] = []
    path: tuple[str, ...] = ()

    def flush() -> None:
        whole = " ".join("".join(t for t, _ in text).split())
        if whole:
            linked = sum(len(" ".join(t.split())) for t, a in text if a)
            blocks.append(Block(path, whole, min(linked, len(whole))))
        text.clear()

    links = 0

    def push(name: str, step: str) -> None:
        nonlocal path, links
        stack.append((name, step))
        links += name == "a"
        if name in BLOCKS or name in DROPPED_TAGS or "." in step:
            path = (*path, step)
            paths.append(path)

    def pop_to(at: int) -> None:
        nonlocal path, links
        gone = stack[at:]
        del stack[at:]
        links -= sum(n == "a" for n, _ in gone)
        shown = sum(n in BLOCKS or n in DROPPED_TAGS or "." in s for n, s in gone)
        if shown:
            path = path[: len(path) - shown]

    def last(names: frozenset[str] | tuple[str, ...], stop: tuple[str, ...] = ()) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in stop:
                break
        return -1

    at = 0
    while True:
        m = _TOKENS.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            text.append((entities.unescape(page[at:end]), links > 0))
        if not m:
            break
        at, tag = m.end(), m.group()
        if tag.startswith("<![CDATA["):
            text.append((tag[9:].removesuffix("]]>"), False))
            continue
        if (named := _NAME.match(tag)) is None:
            continue
        name = named.group(1).lower()
        if tag[1] == "/":
            if (i := last((name,))) >= 0:
                if name in BLOCKS or name in DROPPED_TAGS:
                    flush()
                pop_to(i)
            continue
        if name in BLOCKS or name in DROPPED_TAGS:
            flush()
        elif name in ("br", "td", "th", "img"):
            text.append((" ", False))
        if name in CLOSES_P and (i := last(("p",), ("table", "button"))) >= 0:
            pop_to(i)
        for same, stop in ((("li",), ("ul", "ol", "menu")), (("dt", "dd"), ("dl",)), (("tr",), ("table",)), (("option",), ("select",))):
            if name in same and (i := last(same, stop)) >= 0:
                pop_to(i)
        if name in VOID or tag.endswith("/>") and name in ("svg", "path"):
            continue
        if name in RAW:
            push(name, name)
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            pop_to(len(stack) - 1)
            continue
        step = _step(tag, name)
        if "." in step and name not in BLOCKS and _says_no(step, False):
            flush()
        push(name, step)
    flush()
    return paths, blocks


def _marks(step: str) -> tuple[str, list[str]]:
    """The name of a step and its marks; ids of elements that hold text are left out."""
    name, *marks = step.split(".")
    return name, [m.removeprefix("#") for m in marks if not (m.startswith("#") and name in TEXT_TAGS)]


def _says_no(step: str, words: bool = True) -> bool:
    """Whether a step is boilerplate by its element or marks: by single words of containers' marks, or by whole marks only."""
    name, marks = _marks(step)
    if name in DROPPED_TAGS or any(m in DROPPED_WORDS for m in marks):
        return True
    return words and name not in TEXT_TAGS and any(w in DROPPED_WORDS for m in marks for w in _WORDS.findall(m))


def _says_no_in_main(step: str) -> bool:
    name, marks = _marks(step)
    return (name in DROPPED_TAGS and name != "header") or any(m in DROPPED_IN_MAIN for m in marks)


def _says_main(step: str) -> bool:
    name, marks = _marks(step)
    return name in MAIN_TAGS or any(m in MAIN_WORDS for m in marks)


def host_of():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


_TOKEN_ROW = "host string, token string, pages long, most int, print long, total long, place double, chars long, linked long, low long, high long, contents array<long>"
#: Between the path and the hash of a text.
TEXT = "\0"


def text_token(block: Block) -> str:
    return f"{'/'.join(block.path)}{TEXT}{_hash(block.text):x}"


def tokens_of(paths: list[tuple[str, ...]], blocks: list[Block]) -> dict[str, list]:
    """Of each token of a page: how often it occurs, its first place, characters of text and of links, and its texts."""
    own: dict[str, list] = {"": [1, -1, 0, 0, []]}
    for i, path in enumerate(paths):
        own.setdefault("/".join(path), [0, i, 0, 0, []])[0] += 1
    for b in blocks:
        for n in range(len(b.path) + 1):
            t = own.setdefault("/".join(b.path[:n]), [1, 0, 0, 0, []])
            t[2] += len(b.text)
            t[3] += b.linked
            t[4].append(b.text)
        own.setdefault(text_token(b), [0, 0, len(b.text), b.linked, [b.text]])[0] += 1
    return own


def _page_tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per host and token of a batch of pages: what the vectors and slots need, in a form that can be summed."""
    for frame in frames:
        seen: dict[tuple[str, str], list] = {}
        for host, key, page in zip(frame["host"], frame["key"], frame["html"]):
            paths, blocks = parse(page)
            if not paths:
                continue
            content = _hash("\n".join(b.text for b in blocks))
            for token, (n, place, chars, linked, texts) in tokens_of(paths, blocks).items():
                same, mark = _hash("\n".join(texts)), _hash(f"{key} {n}")
                t = seen.setdefault((host, token), [0, n, 0, 0, 0.0, 0, 0, same, same, []])
                t[0] += 1
                t[1] = max(t[1], n)
                t[2] ^= mark
                t[3] += mark & 0xFFFFFFFF
                t[4] += place
                t[5] += chars
                t[6] += linked
                t[7], t[8] = min(t[7], same), max(t[8], same)
                if len(t[9]) < SAME_PAGES and content not in t[9]:
                    t[9].append(content)
        yield pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=[c.split()[0] for c in _TOKEN_ROW.split(", ")])


def _tokens(pages: DataFrame) -> DataFrame:
    """The tokens of each host with the fingerprints of their vectors."""
    rows = pages.select(host_of().alias("host"), F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("key"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInPandas(_page_tokens, _TOKEN_ROW).groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.max("most").alias("most"), F.bit_xor("print").alias("print"), F.sum("total").alias("total"), F.sum("place").alias("place"),
        F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.size(F.array_distinct(F.flatten(F.collect_set("contents")))).alias("contents"),
    )


def templates(tokens: DataFrame) -> DataFrame:
    """(host, token, pages, constant, linked, chars, place) for the tokens of each host's template, before they are nested.

    Tokens of a host with the same vector, by number of pages and fingerprints, are one class. Listed are the classes whose
    tokens occur once on each page, of all pages or of ``SAME_PAGES``; of texts only those that are on all pages.
    """
    vector = ["pages", "print", "total"]
    root = tokens.where("token = ''").select("host", F.struct(*vector).alias("root_vector"), F.col("contents").alias("all_contents"))
    classes = tokens.where("most = 1").select("*", F.struct(*vector).alias("vector")).join(root, "host")
    whole, text = F.col("vector") == F.col("root_vector"), F.instr("token", TEXT) > 0
    told = F.col("contents") >= SAME_PAGES
    constant = told & (F.col("low") == F.col("high"))
    share = F.when(F.col("chars") > 0, F.col("linked") / F.col("chars")).otherwise(0.0)
    return classes.where((whole & (~text | told)) | (~text & (F.col("pages") >= SAME_PAGES))).select("host", "token", "pages", constant.alias("constant"), share.alias("linked"), (F.col("chars") / F.col("pages")).alias("chars"), (F.col("place") / F.col("pages")).alias("place"))


@dataclass
class Slot:
    """An element of a host's template, or a text of it. ``mass`` is by page, ``own`` is the part outside of inner slots."""

    pages: int
    constant: bool
    linked: float
    chars: float
    place: float
    mass: float = 0.0
    own: float = 0.0


def _parent(token: str) -> str:
    return token.partition(TEXT)[0] if TEXT in token else token.rpartition("/")[0]


def nested(rows: dict[str, Slot]) -> dict[str, Slot]:
    """The tokens whose parents, up to the root, belong to the template as well, with their mass.

    Texts of the root class may lie in any element.
    """
    out: dict[str, Slot] = {}
    for token in sorted(rows, key=lambda t: (TEXT in t, t.count("/"), t)):
        if TEXT in token or token == "" or _parent(token) in out:
            out[token] = rows[token]
    total = {t: 0.0 if s.constant else s.pages * s.chars * (1 - s.linked) for t, s in out.items() if TEXT not in t}
    for token, slot in out.items():
        above = [t for n in range(token.count("/") + 1) if (t := "/".join(_parent(token).split("/")[:n]) if n else "") in total] if token else []
        if TEXT in token:
            above += [_parent(token)] if _parent(token) in total else []
        if (slot.constant or TEXT in token) and not any(out[t].constant for t in above):
            for t in set(above):
                total[t] -= slot.pages * slot.chars * (1 - slot.linked)
    inner = defaultdict(float)
    for token, mass in total.items():
        if token:
            inner[_parent(token)] += mass
    for token, mass in total.items():
        out[token].mass, out[token].own = max(mass, 0.0) / out[token].pages, max(mass - inner[token], 0.0) / out[token].pages
    return out


@lru_cache(256)
def _read(template: str) -> dict[str, Slot]:
    return nested({t["token"]: Slot(t["pages"], t["constant"], t["linked"], t["chars"], t["place"]) for t in json.loads(template)})


def in_order(paths: list[tuple[str, ...]], template: dict[str, Slot]) -> set[str]:
    """The template's elements that a page has, once and not after one that comes later on the host."""
    count = Counter("/".join(p) for p in paths)
    found, last = {""}, -1.0
    for path in paths:
        token = "/".join(path)
        if token in template and count[token] == 1 and "/".join(path[:-1]) in found and template[token].place >= last:
            found.add(token)
            last = template[token].place
    return found


def _is_text(token: str) -> bool:
    return token.rpartition("/")[2].split(".")[0] in TEXT_TAGS


def _ruling(found: set[str]) -> set[str]:
    """The found slots that say that they are no article, by single words only if none of them holds an article's element."""
    holders = {"/".join(t.split("/")[:n]) for t in found if _says_main(t.rpartition("/")[2]) for n in range(t.count("/") + 2)}
    return {t for t in found if t and _says_no(t.rpartition("/")[2], t not in holders)}


def main_slot(found: set[str], template: dict[str, Slot]) -> str:
    """The slot that holds the article, by the mass of what the host's pages say in it."""
    ruling, inner, mass = _ruling(found), defaultdict(list), defaultdict(float)
    for token in found - {""}:
        mass[_parent(token)] += template[token].mass
        if not _is_text(token) and token not in ruling and template[token].linked < LINKED:
            inner[_parent(token)].append(token)
    at = ""
    while inner[at]:
        weight = {t: template[t].mass * (MAIN_WEIGHT if _says_main(t.rpartition("/")[2]) else 1) for t in inner[at]}
        best = max(sorted(weight), key=weight.__getitem__)
        if weight[best] <= 0 or weight[best] < DOMINANT * (template[at].own + mass[at] + weight[best] - template[best].mass):
            break
        at = best
    return at


def _ruled_out(steps: tuple[str, ...], main: str, found: set[str], ruling: set[str], template: dict[str, Slot], texts: bool) -> bool:
    """Whether a block below the main slot is none of the article, by what lies between them."""
    at, article = main, any(map(_says_main, main.split("/")))
    for step in steps:
        at = f"{at}/{step}" if at else step
        slot = template[at] if at in found else None
        if slot is not None and not _is_text(at) and (slot.linked >= LINKED or (slot.constant and texts)):
            return True
        if step.split(".")[0] in ("html", "body"):
            continue
        if _says_no_in_main(step) or (not article and (step.split(".")[0] == "header" or at in ruling)):
            return True
        article = article or _says_main(step)
    return False


def chosen(paths: list[tuple[str, ...]], blocks: list[Block], template: dict[str, Slot]) -> list[str]:
    """The texts of the article. Without a template (a page without elements), all that no element rules out."""
    if not template:
        return [b.text for b in blocks if not any(s.split(".")[0] in DROPPED_TAGS for s in b.path)]
    found = in_order(paths, template)
    ruling, main = _ruling(found), main_slot(found, template)
    depth = len(main.split("/")) if main else 0
    within = lambda b: depth == 0 or "/".join(b.path[:depth]) == main
    article = any(map(_says_main, main.split("/")))
    constant = sum(t.chars for k, t in template.items() if TEXT in k and (not main or k.startswith((main + "/", main + TEXT))))
    texts = 2 * constant < template[main].chars
    around = {"/".join(main.split("/")[:n]) for n in range(depth)}
    out = []
    for b in blocks:
        inside = within(b)
        if texts and not (inside and article) and text_token(b) in template:
            continue
        if inside:
            if not _ruled_out(b.path[depth:], main, found, ruling, template, texts):
                out.append(b.text)
            continue
        slot = next(t for n in range(len(b.path), -1, -1) if (t := "/".join(b.path[:n])) in found and not _is_text(t))
        headline = bool(b.path) and b.path[-1].split(".")[0] == "h1"
        if slot in around and not any(map(_says_no_in_main, b.path)) and (headline or (template[slot].own >= BESIDE * template[main].mass and b.linked < LINKED * len(b.text))):
            out.append(b.text)
    return out


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = ["\n".join(chosen(*parse(page), _read(template) if isinstance(template, str) else {})) for page, template in zip(frame["html"], frame["template"])]
        yield pd.DataFrame({"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""
    tokens = cut(_tokens(pages))
    entry = F.struct("token", "pages", "constant", "linked", "chars", "place")
    per_host = cut(templates(tokens).groupBy(F.col("host").alias("of_host")).agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("template")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of().alias("host"))
    if (per_host.agg(F.sum(F.length("template"))).first()[0] or 0) <= FEW_BYTES:
        # A host's pages come in a row, so a task reads each template once; beyond, the join sorts them.
        met = rows.sortWithinPartitions("host").join(F.broadcast(per_host), F.col("host") == F.col("of_host"), "left")
    else:
        large = cut(tokens.where((F.col("token") == "") & (F.col("pages") > PAGES)).select(F.col("host").alias("large_host"), F.ceil(F.col("pages") / PAGES).cast("int").alias("parts")))
        if large.count() <= FEW_HOSTS:
            large = F.broadcast(large)
        parted = lambda df, host: df.join(large, F.col(host) == F.col("large_host"), "left").withColumn("parts", F.coalesce("parts", F.lit(1))).drop("large_host")
        spread = parted(per_host, "of_host").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        rows = parted(rows, "host").withColumn("page_part", F.pmod(F.xxhash64("page_id", "html"), F.col("parts")).cast("int"))
        met = rows.join(spread, (F.col("host") == F.col("of_host")) & (F.col("page_part") == F.col("part")), "left")
    return met.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), "template").mapInPandas(_extract, "page_id long, url string, text string, n_chars long")
