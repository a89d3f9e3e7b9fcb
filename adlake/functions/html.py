"""Page text to elements. The only step that runs Python on the executors, besides
entity unescaping: batches of pages go through the standard HTML parser by Arrow and come
back as an array column; all further work is column expressions."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The parser travels with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ELEMENTS = T.ArrayType(T.StructType([
    T.StructField("pos", T.IntegerType()), T.StructField("parent", T.IntegerType()),
    T.StructField("last", T.IntegerType()), T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
]))
_ELEMENT_ARROW = pa.list_(pa.struct([
    ("pos", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("classes", pa.list_(pa.string())),
    ("start", pa.int32()), ("end", pa.int32()),
]))
PAGE = T.StructType([T.StructField("page_text", T.StringType()), T.StructField("text_base", T.IntegerType()),
                     T.StructField("elements", ELEMENTS)])
_PAGE_ARROW = pa.struct([("page_text", pa.string()), ("text_base", pa.int32()), ("elements", _ELEMENT_ARROW)])

# Elements that never have content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr"}
# Elements whose text is not for reading.
HIDDEN = {"script", "style"}
# Elements that start a new line of plain text.
BLOCK = {"address", "article", "blockquote", "body", "br", "dd", "div", "dl", "dt", "footer",
         "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav",
         "ol", "p", "section", "table", "td", "th", "title", "tr", "ul"}
# An open element of the value is closed by the start of the key.
CLOSED_BY = {"li": {"li"}, "p": {"p"}, "tr": {"td", "th", "tr"}, "td": {"td", "th"},
             "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "a": {"a"}}
# ... but never across one of these.
SCOPE = {"ul", "ol", "table", "dl", "div", "article", "section", "nav", "body"}


# Tokens that can be read in one way only: text, a start tag (attributes bare or in quotes), an end tag, a
# plain comment, the document type. Any other '<' is left to the standard parser, and so are elements with
# a content of their own kind, but for titles, scripts and styles that hold no '<'.
_BLANK = "[ \\t\\n\\r\\f]"
_TOKEN = re.compile(
    r"([^<]+)"
    r"|<((?i:title)(?=>[^<]*+</(?i:title)>)|(?i:script)(?=>[^<]*+</(?i:script)>)|(?i:style)(?=>[^<]*+</(?i:style)>)"
    r"|(?!(?i:script|style|xmp|iframe|noembed|noframes|noscript|plaintext|textarea|title))[a-zA-Z][a-zA-Z0-9]*+"
    rf"(?:{_BLANK}++[a-zA-Z_:][a-zA-Z0-9_:.-]*+(?:=(?:\"[^\"]*+\"|'[^']*+'))?)*+{_BLANK}*+/?)>"
    rf"|</([a-zA-Z][a-zA-Z0-9]*+){_BLANK}*+>"
    r"|<!--[^<>-]*+-->|<!(?i:doctype)[^<>]*+>"
    r"|(<)")
_NAME = re.compile("[a-zA-Z0-9]+")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][a-zA-Z0-9_:.-]*+)(?:=(?:\"([^\"]*+)\"|'([^']*+)'))?")
# Start tags come again from page to page; so many are remembered in a task, if they are short.
_REMEMBERED, _SHORT = 5_000, 200


def _own(attrs: dict[str, str | None]) -> tuple[list[tuple[str, str]], list[str]]:
    """Attributes as they are returned, and the classes."""
    return [(k, v or "") for k, v in attrs.items()], (attrs.get("class") or "").split()


class _Tag(HTMLParser):
    def handle_starttag(self, tag, attrs):
        self.attrs = dict(attrs)


def _start_tag(tag: str) -> tuple[str, list[tuple[str, str]], list[str], bool]:
    """Name, attributes, classes and whether it ends itself, of the inside of a start tag as in ``_TOKEN``."""
    name = _NAME.match(tag).group()
    if "&" in tag:   # entities in links have rules of their own
        read = _Tag()
        read.feed(f"<{tag}>")
        attrs = read.attrs
    else:
        attrs = {k.lower(): a or b for k, a, b in _ATTRIBUTE.findall(tag, len(name))}
    return name.lower(), *_own(attrs), tag.endswith("/")


class _Parser(HTMLParser):
    def __init__(self, known: dict | None = None):
        super().__init__(convert_charrefs=True)
        self.known = {} if known is None else known   # start tags of earlier pages

    def read(self, page: str) -> None:
        """The whole page: by plain tokens if it has no others, else by the standard parser, with the same calls."""
        tokens = _TOKEN.findall(page)
        if any(token[3] for token in tokens):
            self.feed(page)
            self.close()
            return
        known, plain = self.known, False
        for text, start, end, _ in tokens:
            if text:
                self.handle_data(text if plain or "&" not in text else unescape(text))
            elif start:
                told = known.get(start)
                if told is None:
                    told = _start_tag(start)
                    if len(start) <= _SHORT:
                        if len(known) >= _REMEMBERED:
                            known.clear()
                        known[start] = told
                tag, attrs, own, ends = told
                plain = tag in HIDDEN   # no entities in there
                self.start(tag, attrs, own)
                if ends:
                    self.handle_endtag(tag)
            elif end:
                plain = False
                self.handle_endtag(end.lower())

    def handle_starttag(self, tag, attrs):
        self.start(tag, *_own(dict(attrs)))

    def updatepos(self, i, j):
        return j  # line numbers are not used

    def parse_marked_section(self, i, report=1):
        # '<![...' that is no known section: skipped to its '>', as browsers do.
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)


class _Elements(_Parser):
    """Collects the wanted elements of one page, and the text inside them once. An element has the
    places where its own text starts and ends, so nested elements repeat nothing."""

    def __init__(self, wanted: Mapping[str, frozenset[str] | None], known: dict | None = None):
        super().__init__(known)
        self.wanted = wanted
        self.found: list[dict] = []
        self.open: list[tuple[str, int | None]] = []
        self.inside: list[int] = []  # the wanted ones among the open elements
        # How often each tag is open: a tag that is not open need not be looked for.
        self.times: Counter[str] = Counter()
        self.parts: list[str] = []
        self.length = 0

    def _is_wanted(self, tag, own) -> bool:
        if tag not in self.wanted:
            return False
        classes = self.wanted[tag]
        return classes is None or not classes.isdisjoint(own)

    def start(self, tag, attrs, own):
        closes = CLOSED_BY.get(tag)
        if closes and any(self.times[name] for name in closes):
            for depth in range(len(self.open) - 1, -1, -1):
                name = self.open[depth][0]
                if name in closes:
                    self._close(depth)
                    break
                if name in SCOPE:
                    break
        pos = None
        if self._is_wanted(tag, own):
            parent = self.inside[-1] if self.inside else None
            pos = len(self.found)
            self.found.append({"pos": pos, "parent": parent, "last": pos, "tag": tag,
                               "attrs": attrs, "classes": own,
                               "start": self.length, "end": self.length})
        if tag not in VOID:
            self.open.append((tag, pos))
            self.times[tag] += 1
            if pos is not None:
                self.inside.append(pos)

    def handle_endtag(self, tag):
        if self.times[tag]:
            depth = len(self.open) - 1
            while self.open[depth][0] != tag:
                depth -= 1
            self._close(depth)

    def _close(self, depth: int) -> None:
        for tag, pos in self.open[depth:]:
            self.times[tag] -= 1
            if pos is not None:
                self.found[pos]["last"] = len(self.found) - 1
                self.found[pos]["end"] = self.length
                self.inside.pop()
        del self.open[depth:]

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)
            self.length += len(data)

    def parsed(self, page: str) -> dict:
        self.read(page)
        self._close(0)
        return {"page_text": "".join(self.parts), "text_base": 0, "elements": self.found}


class _PlainText(_Parser):
    """Visible text of one page; blocks on lines of their own, link targets dropped."""

    def __init__(self, known: dict | None = None):
        super().__init__(known)
        self.parts: list[str] = []
        self.hidden = 0

    def start(self, tag, attrs, own):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in BLOCK:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCK:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            # Line breaks inside a run of text are plain blanks in HTML.
            self.parts.append(" ".join(data.split("\n")))

    def text(self, page: str) -> str:
        self.read(page)
        lines = (" ".join(line.split()) for line in "".join(self.parts).split("\n"))
        return "\n".join(line for line in lines if line)


def _map_pages(pages: DataFrame, keep: Sequence[str], html: str, name: str, spark_type: T.DataType,
               arrow_type: pa.DataType, convert) -> DataFrame:
    kept = pages.select(*keep, html)
    schema = T.StructType(kept.schema.fields[:-1]).add(name, spark_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            # Small steps keep the parsed elements of few pages in memory at once.
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                cells = [None if page is None else convert(page, known)
                         for page in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(cells, arrow_type)], names=[*keep, name])

    return kept.mapInArrow(run, schema)


def parse_elements(pages: DataFrame, tags: Sequence[str] | Mapping[str, Sequence[str] | None],
                   keep: Sequence[str] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """``keep`` columns, ``elements`` (the wanted tags of each page in document order), and
    ``page_text`` with ``text_base``, from which ``pages.raw_text`` takes an element's text.

    ``tags`` is a list, or a mapping of tag to the CSS classes one of which it must have
    (None for any). ``parent`` is the ``pos`` of the nearest wanted element around an
    element, and those inside it are at pos + 1 to ``last``. A null page gives null. What
    is returned grows with the page, however its elements are nested.
    """
    if not isinstance(tags, Mapping):
        tags = dict.fromkeys(tags)
    wanted = {tag: None if classes is None else frozenset(classes) for tag, classes in tags.items()}
    parsed = _map_pages(pages, keep, html, "_page", PAGE, _PAGE_ARROW, lambda page, known: _Elements(wanted, known).parsed(page))
    return parsed.select(*keep, "_page.*")


def plain_text(pages: DataFrame, keep: Sequence[str] = ("page_id",), html: str = "html") -> DataFrame:
    """``keep`` columns and ``text``: the readable text of each page."""
    return _map_pages(pages, keep, html, "text", T.StringType(), pa.string(),
                      lambda page, known: _PlainText(known).text(page))
