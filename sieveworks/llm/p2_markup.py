"""Markup residue in text documents (problem 2).

Method: every page with a sign of markup is streamed through the standard library's HTML parser. Its events are the
evidence: tags, comments, declarations and entities that it reports make a page html, and what it passes on as data is
scanned for the constructs of Markdown, wiki and LaTeX, which the library has no parser for; each one found is an event
of its own kind on its line. Every line carries its text-to-tag ratio over all those events; the ratios are smoothed
with a Gaussian kernel and split into two clusters by the threshold of greatest separation. Lines of the low cluster
that are mere links or signs (menus, link bars, residue of layout) are left out and counted, unless they are headings, list items,
table rows, code or formulas, which are kept whatever their ratio. The kinds of a page are those of its events.

The clean text shows structure without markup: headings stand as paragraphs of their own, list items begin with a
dash or number, cells are joined by bars, code is indented by four blanks, formulas keep their source.

Pages without any sign that could be markup never leave the JVM; nothing is shuffled but the narrow results.

Defined results: null and empty texts have no markup and clean to themselves; broken or unclosed tags are closed at
the end of the page; a page delivered again counts once; extra columns are ignored.
"""

from __future__ import annotations

import html
import html.entities
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.sources.tables import latest
from sieveworks.storage import table

HTML, MARKDOWN, WIKI, LATEX = "html", "markdown", "wiki", "latex"

_TAGS = (
    "a abbr address article aside b blockquote body br button caption center cite code col colgroup dd del details div dl dt em "
    "fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link "
    "main map mark meta nav noscript object ol optgroup option p param pre q s samp script section select small span strike "
    "strong style sub summary sup svg table tbody td template textarea tfoot th thead title tr tt u ul var video wbr"
).split()
_KNOWN = frozenset(_TAGS)
#: a bracket before what is no known tag, comment or declaration
_LOOSE = re.compile(r"<(?!/?(?:%s)(?=[\s/>])|!--|!doctype)" % "|".join(_TAGS), re.I)
_BLOCKS = {*"address article aside blockquote body caption center dd details div dl dt fieldset figure footer form header hr html main nav ol p section table tbody tfoot thead title ul".split()}
_SILENT = {"script", "style", "noscript", "template", "svg", "head"}

_FENCE = re.compile(r"^(```+|~~~+)[^\n`]*\n(.*?)(?:^\1[ \t]*$|\Z)", re.M | re.S)
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\}(?:\[[^\]\n]*\]|\{[^}\n]*\})*\n?(.*?)\\end\{\1\}", re.S)
_FORMULA_ENV = re.compile(r"\\begin\{(equation|align|displaymath|eqnarray|gather|math)\*?\}(.*?)\\end\{\1\*?\}", re.S)
_BRACKETED = re.compile(r"\\\[(.+?)\\\]|\\\((.+?)\\\)", re.S)
_DOLLARS = re.compile(r"\$\$(.+?)\$\$|(?<![\\$\w])\$(?=[^\s$\d]|\d[^\s$]*[\^_=\\])((?:[^$\n\\]|\\.)*?[\^_=\\](?:[^$\n\\]|\\.)*?)(?<!\s)\$(?![\w$])", re.S)

_COMMAND = re.compile(r"\\[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?\{|\\(?:item|hline|maketitle|tableofcontents|centering|noindent|par|ldots|newpage)\b|\{\\[a-z]{2,}\s")
_MD = re.compile(
    r"(?<![\w*])\*\*\*?(?=\S)[^*\n]+?(?<=\S)\*\*\*?(?![\w*])|(?<![\w*\\])\*(?=[^\s*])[^*\n]*?(?<=[^\s*])\*(?![\w*])|(?<![\w_])__(?=\S)(?![A-Z]+__)[^_\n]+?(?<=\S)__(?![\w_])"
    r"|(?<![\w_/.@-])_(?=[^\s_])[^_\n]*?(?<=[^\s_])_(?![\w_@])|~~(?=\S)[^~\n]+?(?<=\S)~~|`[^`\n]+`|!?\[[^\]\n]*\]\([^()\s]*(?: \"[^\"\n]*\")?\)|\[\^[^\]\s]+\]"
    r"|^\[[^\]\n]+\]: \S+$|^ {0,3}(?:- |\* )\[[ xX]\] |^ {0,3}>+ ?(?=\S)|^[ |:-]*-{3,}[ |:-]*\|[ |:-]*$|^\|[ |:-]*-{3,}[ |:-]*$",
    re.M,
)
_SETEXT = re.compile(r"^(?=[^\n|]*\w)([^\n|]+)\n(={3,}|-{3,})[ \t]*$", re.M)
_ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S[^\n]*?)[ \t]*#*[ \t]*$", re.M)
_STAR = re.compile(r"^[ \t]*[*+][ \t]+(?=\S)", re.M)
_WIKI = re.compile(
    r"^(={1,6})[ \t]*[^=\n]+?[ \t]*\1[ \t]*$|\[\[[^\[\]\n]+\]\]|\{\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}\}|'''?(?=[^\s'])[^'\n]*(?:'(?!')[^'\n]*)*'''?|^\{\|[^\n]*$|^\|\}\s*$|^\|-+\s*$"
    r"|__(?:NO|FORCE)?(?:TOC|EDITSECTION|INDEX|GALLERY|TITLECONVERT)__|^\*{2,} |\[https?://\S+ [^\]\n]+\]",
    re.M,
)
_LINE_CODE = re.compile(r"^(?: {2,}|\t)\S", re.M)


class _Events(HTMLParser):
    """Turns parser events into lines of text; each line counts its tags. ``marks`` counts what is html at all.

    What only looks like a tag (an address in angle brackets, a comparison) is data again.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.lines: list[list] = [["", 0, False, 0, 0]]  # text, tags, kept in any case, links, characters of links
        self.marks = self.loose = 0  # html events, and references that stand for loose brackets
        self.silent = 0
        self.pre = 0
        self.anchor = 0
        self.cells = 0
        self.order: list[int | None] = []

    def _line(self, keep: bool = False) -> None:
        if self.lines[-1][0].strip() or self.lines[-1][2]:
            self.lines.append(["", 0, keep, 0, 0])
        else:
            self.lines[-1][0] = ""
            self.lines[-1][2] = keep

    def _gap(self) -> None:
        self._line()
        if len(self.lines) > 1 and self.lines[-2][0]:
            self.lines.append(["", 0, False, 0, 0])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in _KNOWN:
            return self.handle_data(self.get_starttag_text() or "")
        self.marks += 1
        self.lines[-1][1] += 1
        if tag in _SILENT:
            self.silent += tag not in ("head",)
        elif tag == "a":
            self.anchor += 1
            self.lines[-1][3] += 1
        elif tag == "br":
            self.lines.append(["", 0, self.lines[-1][2], 0, 0])
        elif tag == "pre":
            self._gap()
            self.pre += 1
            self.lines[-1][0], self.lines[-1][2] = "    ", True
        elif tag in ("td", "th"):
            if self.cells:
                self.lines[-1][0] = self.lines[-1][0].rstrip() + " | "
            self.cells += 1
        elif tag == "tr":
            self._line(True)
            self.cells = 0
        elif tag == "li":
            self._line(True)
            if self.order and self.order[-1] is not None:
                self.order[-1] += 1
                self.lines[-1][0] = f"{self.order[-1]}. "
            else:
                self.lines[-1][0] = "- "
        elif tag in ("ol", "ul"):
            self.order.append(0 if tag == "ol" else None)
            self._gap()
        elif re.fullmatch("h[1-6]", tag):
            self._gap()
            self.lines[-1][2] = True
        elif tag in _BLOCKS:
            self._gap()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in _KNOWN:
            return self.handle_data(self.get_starttag_text() or "")
        self.marks += 1
        self.lines[-1][1] += 1
        if tag == "br":
            self.lines.append(["", 0, self.lines[-1][2], 0, 0])

    def handle_endtag(self, tag: str) -> None:
        if tag not in _KNOWN:
            return self.handle_data(f"</{tag}>")
        self.marks += 1
        self.lines[-1][1] += 1
        if tag in _SILENT:
            self.silent = max(0, self.silent - (tag not in ("head",)))
        elif tag == "a":
            self.anchor = max(0, self.anchor - 1)
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self._gap()
        elif tag in ("ol", "ul"):
            if self.order:
                self.order.pop()
            self._gap()
        elif tag == "table" or re.fullmatch("h[1-6]", tag):
            self.cells = 0
            self._gap()
        elif tag in _BLOCKS:
            self._gap()

    def handle_comment(self, data: str) -> None:
        self.marks += 1
        self.lines[-1][1] += 1

    def handle_decl(self, decl: str) -> None:
        self.marks += decl.lower().startswith("doctype")

    def handle_entityref(self, name: str) -> None:
        # only what is written out with its semicolon is an entity; the parser also reports a bare ampersand's word
        sign = html.entities.html5.get(name + ";") if self._ended else None
        self.marks += sign is not None
        self.handle_data(sign if sign is not None else f"&{name}{';' if self._ended else ''}")

    def handle_charref(self, name: str) -> None:
        self.marks += 1
        self.handle_data(html.unescape(f"&#{name};"))

    @property
    def _ended(self) -> bool:
        """Whether the reference that is being reported ends with a semicolon: the parser still stands at its start."""
        return self.rawdata.startswith(";", self._reference_end())

    def _reference_end(self) -> int:
        at = self._at
        end = at + 1
        while end < len(self.rawdata) and self.rawdata[end].isalnum():
            end += 1
        return end

    def updatepos(self, i: int, j: int) -> int:
        self._at = j  # where the parser goes on, so the start of the next construct
        return super().updatepos(i, j)

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if self.pre:
            first, *rest = data.split("\n")
            self.lines[-1][0] += first
            self.lines.extend(["    " + x, 0, True, 0, 0] for x in rest)
            return
        first, *rest = data.split("\n")
        self.lines[-1][0] += first
        self.lines[-1][4] += len(first.strip()) if self.anchor else 0
        for x in rest:
            self.lines.append([x, 0, False, 0, 0])


def smoothed(ratio: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; the ends are continued."""
    reach = np.arange(-3, 4)
    kernel = np.exp(-(reach**2) / (2 * sigma**2))
    return np.convolve(np.pad(ratio, 3, mode="edge"), kernel / kernel.sum(), mode="valid")


def two_clusters(x: np.ndarray, least: float = 0.5) -> float | None:
    """The threshold that separates the values best into two clusters, if they explain ``least`` of the variance."""
    v = np.sort(x)
    if len(v) < 4 or v[-1] <= v[0]:
        return None
    n = np.arange(1, len(v))
    low, total = np.cumsum(v)[:-1], v.sum()
    between = n * (len(v) - n) * (low / n - (total - low) / (len(v) - n)) ** 2
    k = int(np.argmax(between))
    if between[k] / (len(v) ** 2 * v.var()) < least:
        return None
    return float(v[k] + v[k + 1]) / 2


def _residue(text: str, tags: int, keep: bool, links: int, linked: int) -> bool:
    """A line of links for the most part, or of tags without a letter or digit."""
    own = len(text.strip())
    return own > 0 and ((links > 1 and 2 * linked > own) or (tags > 0 and not re.search(r"[^\W_]", text)))


def content_lines(lines: list[list]) -> tuple[list[str], int]:
    """Lines of the content regions, and the number of lines left out.

    The logarithm of the text-to-tag ratio is smoothed and clustered. A line of the low cluster is left out if its own ratio
    lies there too and it is a bar of links or holds no word: a short sentence or a formula among tags is content.
    Structural lines are kept whatever their ratio. Where two clusters do not explain the ratios, all is content.
    """
    full = [k for k, (t, tags, *_) in enumerate(lines) if t.strip() or tags]
    if not full:
        return [x[0] for x in lines], 0
    ratio = np.array([np.log1p(len(lines[k][0].strip()) / max(1, lines[k][1])) for k in full])
    near = smoothed(ratio)
    # structural lines are content in any case, so only the others are clustered
    free = np.array([not lines[k][2] for k in full])
    limit = two_clusters(near[free])
    if limit is None:
        return [x[0] for x in lines], 0
    gone = {k for k, own, x in zip(full, ratio, near, strict=True) if not lines[k][2] and max(own, x) < limit and _residue(*lines[k])}
    return [x[0] for k, x in enumerate(lines) if k not in gone], len(gone)


def convert(text: str | None) -> tuple[str | None, list[str]]:
    """The clean text and the kinds of markup found in it."""
    return cleaned_text(text)[:2]


def cleaned_text(text: str | None) -> tuple[str | None, list[str], int]:
    """The clean text, the kinds of markup found in it and the number of lines left out."""
    if not text:
        return text, [], 0
    dropped = 0
    kinds: set[str] = set()
    kept: list[str] = []

    def hold(block: str) -> str:
        kept.append(block)
        return f"\x02{len(kept) - 1}\x03"

    def indent(code: str) -> str:
        return hold("\n".join("    " + x for x in code.strip("\n").split("\n")))

    def fenced(m: re.Match) -> str:
        kinds.add(MARKDOWN)
        return indent(m.group(2)) + "\n"

    def verbatim(m: re.Match) -> str:
        kinds.add(LATEX)
        return indent(m.group(2))

    text = text.replace("\r\n", "\n").replace("\x02", "").replace("\x03", "")
    text = _VERBATIM.sub(verbatim, _FENCE.sub(fenced, text))

    while "<" in text or "&" in text:
        events = _Events()
        # a bracket that opens nothing would swallow what follows it
        safe, events.loose = _LOOSE.subn("&lt;", text)
        events.feed(safe)
        events.close()
        if events.marks <= events.loose:
            break
        kinds.add(HTML)
        got, gone = content_lines(events.lines)
        dropped += gone
        # what was escaped twice holds tags again
        text = "\n".join(hold(x) if x.startswith("    ") and x.strip() else x.replace("\xa0", " ").rstrip() for x in got)

    math: list[tuple[str, str]] = []

    def formula(m: re.Match) -> str:
        inner = next(g for g in m.groups()[::-1] if g)
        math.append((m.group()[:2], inner))
        return hold(re.sub(r"\s*\n\s*", " ", inner.strip()))

    def environment(m: re.Match) -> str:
        kinds.add(LATEX)
        return hold(re.sub(r"\s*\n\s*", " ", re.sub(r"\\label\{[^}]*\}", "", m.group(2)).strip()))

    text = _FORMULA_ENV.sub(environment, text)
    if "\\(" in text or "\\[" in text:
        text = _BRACKETED.sub(formula, text)
        if math:
            kinds.add(LATEX)
    dollars = len(math)
    if "$" in text:
        text = _DOLLARS.sub(formula, text)
    dollars = len(math) - dollars

    if _COMMAND.search(text):
        kinds.add(LATEX)
        text = _latex(text, hold)
    wiki = bool(_WIKI.search(text))
    if wiki:
        kinds.add(WIKI)
        text = _wiki(text, hold)
    if _MD.search(text) or _SETEXT.search(text) or (not wiki and _ATX.search(text)):
        kinds.add(MARKDOWN)
    if dollars:
        # a formula counts with the markup of its page
        kinds.add(MARKDOWN if MARKDOWN in kinds and LATEX not in kinds else LATEX)
    if len(_STAR.findall(text)) > 1 and not kinds & {MARKDOWN, WIKI}:
        kinds.add(MARKDOWN)
    if MARKDOWN in kinds:
        text = _markdown(text)
    if kinds:
        text = _STAR.sub("- ", text)
    while "\x02" in text:
        text = re.sub("\x02(\\d+)\x03", lambda m: kept[int(m.group(1))], text)
    if kinds:
        text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip("\n")
    return text, sorted(kinds), dropped


_LATEX_HEAD = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph|title)\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}")
_LATEX_DROP = re.compile(
    r"\\(?:label|cite[tp]?|ref|pageref|index|vspace|hspace|usepackage|documentclass|bibliography|bibliographystyle|includegraphics)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}"
    r"|\\(?:hline|maketitle|tableofcontents|centering|noindent|newpage|par|toprule|midrule|bottomrule)\b"
)
_LATEX_LINK = re.compile(r"\\href\{[^{}\n]*\}\{([^{}\n]*)\}")
_LATEX_INLINE = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}")
_LATEX_LIST = re.compile(r"\\begin\{(itemize|enumerate|description)\}(?:\[[^\]\n]*\])?(.*?)\\end\{\1\}", re.S)
_LATEX_TABLE = re.compile(r"\\begin\{(tabular[xy]?|longtable|array)\*?\}(?:\{[^{}\n]*\})*(.*?)\\end\{\1\*?\}", re.S)


def _latex(text: str, hold) -> str:
    def items(m: re.Match) -> str:
        parts = [re.sub(r"\s*\n\s*", " ", x).strip() for x in re.split(r"\\item\b(?:\[[^\]\n]*\])?", m.group(2))]
        found = [x for x in parts if x]
        marks = [f"{k}. " if m.group(1) == "enumerate" else "- " for k in range(1, len(found) + 1)]
        return "\n".join(a + b for a, b in zip(marks, found, strict=True))

    def rows(m: re.Match) -> str:
        body = _LATEX_DROP.sub("", m.group(2))
        got = [" | ".join(c.strip() for c in re.split(r"(?<!\\)&", r)) for r in re.split(r"\\\\(?:\[[^\]\n]*\])?", body)]
        return "\n".join(r for r in got if r.strip(" |\n"))

    text = _LATEX_TABLE.sub(rows, text)
    while _LATEX_LIST.search(text):
        text = _LATEX_LIST.sub(items, text)
    text = _LATEX_HEAD.sub(lambda m: "\n" + m.group(1).strip() + "\n", text)
    text = _LATEX_DROP.sub("", _LATEX_LINK.sub(r"\1", text))
    text = re.sub(r"\\(?:begin|end)\{[^{}\n]*\}", "", text)
    for _ in range(4):  # commands inside commands
        text = _LATEX_INLINE.sub(r"\1", text)
    text = re.sub(r"\{\\[a-z]{2,}\s+([^{}]*)\}", r"\1", text)
    text = re.sub(r"\\item\b\s*", "- ", text)
    return re.sub(r"\\([%&#_{}$])", r"\1", text).replace("\\ldots", "…")


def _wiki(text: str, hold) -> str:
    def template(m: re.Match) -> str:
        name, _, rest = m.group()[2:-2].partition("|")
        if name.strip().lower() in ("math", "code", "nowrap", "tt", "lang"):
            return hold(rest.rpartition("|")[2] if name.strip().lower() == "lang" else rest.strip())
        return ""

    def link(m: re.Match) -> str:
        inner = m.group()[2:-2]
        if re.match(r":?(?:category|file|image|kategorie|categor[íi]a|catégorie):", inner, re.I):
            return ""
        return inner.rpartition("|")[2]

    out, row, number = [], None, 0
    text = re.sub(r"\{\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}\}", template, text)
    text = re.sub(r"\[\[[^\[\]\n]+\]\]", link, text)
    text = re.sub(r"\[https?://\S+ ([^\]\n]+)\]", r"\1", text)
    text = re.sub(r"__(?:NO|FORCE)?(?:TOC|EDITSECTION|INDEX|GALLERY|TITLECONVERT)__\s?", "", text)
    text = re.sub(r"('''?)(?=[^\s'])([^'\n]*(?:'(?!')[^'\n]*)*)\1", r"\2", text)
    text = re.sub(r"'''?", "", text)
    inside = False
    for line in text.split("\n"):
        if re.match(r"\{\|", line):
            inside, row = True, []
            continue
        if inside:
            if re.match(r"\|\}|\|-", line):
                if row:
                    out.append(" | ".join(row))
                row = []
                inside = not line.startswith("|}")
            elif line[:1] in "|!":
                row.extend(c.strip() for c in re.split(r"\|\||!!", line[1:]))
            continue
        m = re.match(r"(={1,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", line)
        if m:
            out.extend(["", m.group(2), ""])
            continue
        m = re.match(r"#+[ \t]*(?=\S)", line)
        number = number + 1 if m else 0
        if m:
            line = f"{number}. {line[m.end():]}"
        elif re.match(r"\*+[ \t]*(?=\S)", line):
            line = "- " + re.sub(r"^\*+[ \t]*", "", line)
        elif re.match(r" {1,}\S", line):
            line = hold("    " + line)
        out.append(line)
    if row:
        out.append(" | ".join(row))
    return "\n".join(out)


def _markdown(text: str) -> str:
    text = _SETEXT.sub(lambda m: "\n" + m.group(1) + "\n", text)
    text = _ATX.sub(lambda m: "\n" + m.group(2) + "\n", text)
    out = []
    for line in text.split("\n"):
        if re.match(r"[ |:-]*-{3,}[ |:-]*$", line) and "|" in line:
            continue
        if re.match(r"\s*\|.*\|\s*$", line):
            line = " | ".join(c.strip() for c in line.strip().strip("|").split("|"))
        out.append(re.sub(r"^ {0,3}(?:>+ ?)+", "", line))
    text = "\n".join(out)
    text = re.sub(r"^\[[^\]\n]+\]: \S+$", "", text, flags=re.M)
    text = re.sub(r"!?\[([^\]\n]*)\]\([^()\s]*(?: \"[^\"\n]*\")?\)", r"\1", text)
    text = re.sub(r"\[\^[^\]\s]+\]:?", "", text)
    text = re.sub(r"^( {0,3}(?:-|\*) )\[[ xX]\] ", r"\1", text, flags=re.M)
    for sign in (r"\*\*\*", r"\*\*", r"(?<![A-Z])__(?![A-Z]+__)", "~~"):
        text = re.sub(rf"(?<!\w){sign}(?=\S)([^*_~\n]+?)(?<=\S){sign}(?!\w)", r"\1", text)
    text = re.sub(r"(?<![\w*])\*(?=[^\s*])([^*\n]*?)(?<=[^\s*])\*(?![\w*])", r"\1", text)
    text = re.sub(r"(?<![\w_/.@-])_(?=[^\s_])([^_\n]*?)(?<=[^\s_])_(?![\w_@])", r"\1", text)
    return re.sub(r"`([^`\n]+)`", r"\1", text)


#: signs without which a text holds no markup
SIGN = r"[<&\\`*_#~\[{}$^+>]|''|={2}|-{3}"


def cleaned(pages: DataFrame) -> DataFrame:
    """(page_id, text) to (page_id, text, kinds, dropped) of the pages that hold markup; ``dropped`` lines were left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, kinds, dropped = [], [], [], []
            for ident, text in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                clean, found, gone = cleaned_text(text)
                if found:
                    ids.append(ident)
                    texts.append(clean)
                    kinds.append(found)
                    dropped.append(gone)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string())), pa.array(dropped, pa.int32())],
                ["page_id", "text", "kinds", "dropped"],
            )

    signed = pages.select(F.col("page_id").cast("long").alias("page_id"), "text").filter(F.col("text").rlike(SIGN))
    return signed.mapInArrow(run, "page_id long, text string, kinds array<string>, dropped int")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(table(spark, sf_dir, "pages")).select("page_id", F.explode("kinds").alias("markup")).distinct()


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page once, in its last delivery, as clean text, with the number of lines left out."""
    pages = latest(table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "text", "loaded_at"), "page_id").select("page_id", "text")
    done = cleaned(pages).withColumnRenamed("text", "clean")
    return pages.join(done, "page_id", "left").select(
        "page_id", F.coalesce("clean", "text").alias("text"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"), F.coalesce("dropped", F.lit(0)).alias("dropped")
    )


QUERIES = {"p2_found": p2_found, "p2_clean": p2_clean}
ORACLE: dict[str, str] = {}
