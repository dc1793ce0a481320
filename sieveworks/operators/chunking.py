"""Chunkers as row-to-rows operators, and checks of what their boundaries separate."""

from __future__ import annotations

import base64
import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.functions import text as T
from sieveworks.operators.extraction import table_runs
from sieveworks.sources.tables import finding
from sieveworks.storage import materialize

#: size and overlap of each preset (fixed values); token windows count words at three quarters
PRESETS = {"langchain": (4000, 200), "llamaindex": (1024, 200), "openai": (800, 400), "tokens": (512, 0), "words": (380, 0)}
#: terms that must stay with their claim (fixed values)
QUALIFIERS = (
    "not", "never", "no", "unless", "except", "excluding", "only", "before", "after", "must",
    "cannot", "can't", "won't", "don't", "doesn't", "isn't", "aren't", "until", "without",
    "provided that", "subject to",
)
#: signs that end a sentence, and limits on what counts as a cut (fixed values)
_SENTENCE_END = re.compile(r"[.!?]+[\"')\]]*\s+|\n[ \t]*\n|\n(?=[ \t]*(?:[-*•#]|\d+[.)]\s))")


def parse_spec(spec: str) -> tuple[str, int, int]:
    """``name[:size[:overlap]]``; raises ValueError unless size > 0 and 0 <= overlap < size."""
    name, *rest = spec.split(":")
    if name == "off" and not rest:
        return "off", 0, 0
    if name not in PRESETS or len(rest) > 2 or (name == "openai" and rest):
        raise ValueError(f"unknown chunker {spec!r}")
    size, overlap = PRESETS[name]
    try:
        size = int(rest[0]) if rest else size
        overlap = int(rest[1]) if len(rest) > 1 else (min(overlap, size - 1) if rest and overlap >= size else overlap)
    except ValueError:
        raise ValueError(f"unknown chunker {spec!r}") from None
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError(f"bad size or overlap in {spec!r}")
    return name, size, overlap


def word_windows(docs: DataFrame, key: str, size: int, overlap: int = 0) -> DataFrame:
    """(key, text) to (key, chunk_no, first_word, n_words, chunk): windows of ``size`` words.

    A window is started as long as it covers a word not covered yet. Slices of an array column copy the array for
    every window, so long texts are cut on Arrow batches instead.
    """
    step = max(1, size - overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, text in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                w = (text or "").split()
                rows.extend((k, i, at, len(w[at : at + size]), " ".join(w[at : at + size])) for i, at in enumerate((x for x in range(0, len(w), step) if x == 0 or x < len(w) - overlap), 1))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", "chunk_no", "first_word", "n_words", "chunk"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(run, f"key {kind}, chunk_no long, first_word long, n_words long, chunk string").withColumnRenamed("key", key)


# ---------------------------------------------------------------- recursive splitter
SEPARATORS = ("\n\n", "\n", " ", "")
SENTENCE_SEPARATORS = ("\n\n", "\n", ". ", "; ", " ", "")


def _pieces(text: str, separators: tuple[str, ...], size: int, lo: int, hi: int) -> Iterator[tuple[int, int, bool]]:
    """Spans below ``size`` in text order; the flag tells that a group of spans to merge ends here.

    A separator stays with the piece it opens. What is still too long is cut by the next separators; with none
    left it stands as it is.
    """
    at = next((k for k, s in enumerate(separators) if not s or text.find(s, lo, hi) >= 0), len(separators) - 1)
    sep, rest = separators[at], separators[at + 1 :]
    if sep:
        cuts = [lo]
        k = text.find(sep, lo, hi)
        while k >= 0:
            if k > cuts[-1]:
                cuts.append(k)
            k = text.find(sep, k + len(sep), hi)
        cuts.append(hi)
    else:
        cuts = list(range(lo, hi + 1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a < size:
            yield a, b, False
            continue
        yield a, a, True
        if sep and rest:
            yield from _pieces(text, rest, size, a, b)
        else:
            yield a, b, True
        yield b, b, True


def recursive_spans(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """Spans of at most ``size`` characters, trimmed of white space, consecutive ones sharing up to ``overlap``."""
    out: list[tuple[int, int]] = []
    window: list[tuple[int, int]] = []

    def emit() -> None:
        if window:
            a, b = window[0][0], window[-1][1]
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if b > a:
                out.append((a, b))

    total = 0
    for a, b, ends in _pieces(text, separators, size, 0, len(text)):
        if ends:
            emit()
            window, total = [], 0
            if b > a:
                window = [(a, b)]
                emit()
                window = []
            continue
        if total + b - a > size:
            emit()
            while total > overlap or (total and total + b - a > size):
                total -= window[0][1] - window[0][0]
                window.pop(0)
        window.append((a, b))
        total += b - a
    emit()
    return out


def recursive_chunks(docs: DataFrame, key: str, size: int = 4000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """(key, text) to (key, chunk_no, start, end, chunk); the recursion is sequential, so it runs on Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i, s, e, t[s:e]) for k, t in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True) if t for i, (s, e) in enumerate(recursive_spans(t, size, overlap, separators), 1)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", "chunk_no", "start", "end", "chunk"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(run, f"key {kind}, chunk_no int, start int, end int, chunk string").withColumnRenamed("key", key)


# ---------------------------------------------------------------- dispatch
Spans = list[tuple[int, int]]
#: a file of ranks of a public byte-level vocabulary; token windows are estimated from words without one
VOCABULARY = "SIEVEWORKS_VOCABULARY"
#: the published pre-tokenising pattern of such vocabularies (fixed value)
TOKEN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Unavailable(RuntimeError):
    """The splitter needs a library that is not installed."""


@lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("given", pat_str=TOKEN_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _windows(ends: list[tuple[int, int]], size: int, overlap: int) -> Spans:
    """Windows over units given as spans; the last window is the first that reaches the last unit."""
    starts = range(0, max(len(ends) - overlap, 1), max(1, size - overlap)) if ends else ()
    return [(ends[i][0], ends[min(i + size, len(ends)) - 1][1]) for i in starts]


def word_spans(text: str, size: int, overlap: int) -> Spans:
    return _windows([m.span() for m in re.finditer(r"\S+", text)], size, overlap)


def token_spans(text: str, size: int, overlap: int, vocabulary: str) -> Spans:
    """Windows of ``size`` tokens; a token that begins inside a character begins with it."""
    encoding = _encoding(vocabulary)
    pieces = encoding.decode_tokens_bytes(encoding.encode_ordinary(text))
    # characters begun before each token: bytes that do not continue a character
    begun = list(accumulate((sum(x & 0xC0 != 0x80 for x in p) for p in pieces), initial=0))
    at = [n if p[0] & 0xC0 != 0x80 else n - 1 for p, n in zip(pieces, begun, strict=False)] + [len(text)]
    return _windows(list(zip(at, at[1:], strict=False)), size, overlap)


def _sentence_library(size: int, overlap: int) -> Callable[[str], Spans]:
    try:
        from llama_index.core import Document
        from llama_index.core.node_parser import SentenceSplitter
    except ImportError:
        raise Unavailable("llama-index-core") from None
    parser = SentenceSplitter(chunk_size=size, chunk_overlap=overlap)

    def spans(text: str) -> Spans:
        nodes = parser.get_nodes_from_documents([Document(text=text)])
        found = [(n.start_char_idx, n.end_char_idx) if n.start_char_idx is not None else (k := text.find(n.get_content()), k + len(n.get_content())) for n in nodes]
        return [x for x in found if x[0] >= 0]

    return spans


def splitter(spec: str = "langchain", vocabulary: str | None = None) -> tuple[Callable[[str], Spans], str]:
    """The spans function that a spec names, and how it may be called in a report.

    ``langchain`` counts characters, ``words`` words, ``tokens`` and ``openai`` tokens of ``vocabulary`` (a path, by default
    that of the environment variable VOCABULARY; without one, words at three quarters). ``llamaindex`` needs its library.
    """
    name, size, overlap = parse_spec(spec)
    vocabulary = vocabulary or os.environ.get(VOCABULARY)
    if name == "langchain":
        return (lambda t: recursive_spans(t, size, overlap)), f"recursive splitter, {size} characters, {overlap} overlap"
    if name == "words":
        return (lambda t: word_spans(t, size, overlap)), f"{size}-word windows, {overlap} overlap"
    if name == "llamaindex":
        return _sentence_library(size, overlap), f"sentence splitter, {size} tokens, {overlap} overlap"
    if name == "off":
        return (lambda t: []), "no splitter"
    if vocabulary:
        return (lambda t: token_spans(t, size, overlap, vocabulary)), f"{size}-token windows, {overlap} overlap"
    wide = max(1, round(0.75 * size))
    narrow = min(round(0.75 * overlap), wide - 1)
    return (lambda t: word_spans(t, wide, narrow)), f"{size}-token windows, {overlap} overlap, estimated as {wide} words"


def chunked(docs: DataFrame, key: str, spec: str = "langchain", vocabulary: str | None = None) -> DataFrame:
    """(key, text) to (key, chunk_no, start, end, chunk) of any splitter."""
    spans, _ = splitter(spec, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i, s, e, t[s:e]) for k, t in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True) if t for i, (s, e) in enumerate(spans(t), 1)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", "chunk_no", "start", "end", "chunk"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(run, f"key {kind}, chunk_no int, start int, end int, chunk string").withColumnRenamed("key", key)


# ---------------------------------------------------------------- what a cut separates
REACH, TAIL, LEFT_WORDS, SENTENCE_WORDS, OPENING = 1500, 400, 4, 80, 4
_ENDS = "chunk_no int, n_chunks int, end int, line int, place string, left_part string, right_part string, tail string, at int"


def boundaries(docs: DataFrame, key: str, spec: str = "langchain", vocabulary: str | None = None) -> DataFrame:
    """(key, text) to one row per chunk end inside the document, from one pass over the texts.

    ``at`` is where the next chunk's text begins, ``left_part`` and ``right_part`` are the sentence round it (null between
    sentences), ``tail`` the last characters of the chunk. ``place`` is page and line where ``docs`` has ``fmt`` and ``pages``.
    """
    spans, _ = splitter(spec, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t, fmt, marks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                cut = spans(t) if t else []
                whole = len(t.rstrip()) if t else 0
                ends = [(no, e) for no, (_, e) in enumerate(cut[:-1], 1) if e < whole]
                if not ends:
                    continue
                gaps = [m.span() for m in _SENTENCE_END.finditer(t)]
                opens, closes = [x for x, _ in gaps], [y for _, y in gaps]
                begins = list(accumulate((m["n"] for m in marks), initial=0))
                for no, e in ends:
                    # a cut inside a word moves to its start, one at white space to the next word
                    at = e if t[e].isspace() or t[e - 1].isspace() else e - len(re.search(r"\S*\Z", t[max(0, e - REACH) : e]).group())
                    at += len(t[at : at + REACH]) - len(t[at : at + REACH].lstrip())
                    i, j = bisect_right(closes, at), bisect_left(opens, at)
                    lo = max(closes[i - 1] if i else 0, at - REACH)
                    hi = min(opens[j] if j < len(opens) else len(t), at + REACH)
                    inside = lo < at < hi
                    page = max(bisect_right(begins[:-1], at) - 1, 0)
                    line = t.count("\n", begins[page], at) + 1 + marks[page]["line_offset"]
                    place = f"p.{marks[page]['number']}, line {line}" if fmt == "pdf" else f"line {line}"
                    rows.append((k, no, len(cut), e, line, place, t[lo:at] if inside else None, t[at:hi] if inside else None, t[max(0, e - TAIL) : e], at))
            cols = list(zip(*rows, strict=True)) or [[]] * 10
            kinds = [b.schema.field(0).type, *[pa.int32()] * 4, *[pa.string()] * 4, pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", *(x.split()[0] for x in _ENDS.split(", "))])

    one = F.array(F.struct(F.lit(0).alias("n"), F.lit(1).alias("number"), F.lit(0).alias("line_offset")))
    paged = F.transform("pages", lambda p: F.struct((F.length(F.coalesce(p.text, F.lit(""))) + 2).alias("n"), p.number.alias("number"), F.coalesce(p.line_offset, F.lit(0)).alias("line_offset"))) if "pages" in docs.columns else one
    fmt = F.col("fmt") if "fmt" in docs.columns else F.lit("")
    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), "text", fmt.alias("fmt"), F.when(F.size(paged) > 0, paged).otherwise(one).alias("marks")).mapInArrow(run, f"key {kind}, {_ENDS}").withColumnRenamed("key", key)


def cut_sentences(ends: DataFrame) -> DataFrame:
    """Chunk ends that keep a claim and leave its condition to the next chunk; adds ``qualifier``."""
    left, right = T.words("left_part"), T.words("right_part")
    whole = (F.size(left) >= LEFT_WORDS) & (F.size(right) > 0) & (F.size(left) + F.size(right) <= SENTENCE_WORDS)
    plain = ~F.concat("left_part", "right_part").contains("|")
    return ends.filter(F.col("left_part").isNotNull() & whole & plain).withColumn("qualifier", qualifier_of(F.array_join(F.slice(right, 1, OPENING), " "))).filter("qualifier <> ''")


def orphan_headings(ends: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks, but for the last, that end in a heading with fewer than ten words after it."""
    lines = F.filter(T.lines("tail"), lambda x: T.strip(x) != "")
    two = F.slice(lines, F.greatest(F.size(lines) - 1, F.lit(1)), 2)
    md = F.col("fmt").isin("md", "txt")
    final, prior = F.try_element_at(two, F.lit(-1)), F.when(F.size(two) > 1, F.try_element_at(two, F.lit(1)))
    found = F.when(T.is_heading(final, md), final).when(T.is_heading(prior, md) & (T.word_count(final) < 10), prior)
    both = ends if "fmt" in ends.columns else ends.join(docs.select("path", "fmt"), "path")
    return both.select("path", "chunk_no", T.strip(found).alias("heading")).filter("heading is not null")


def split_tables(ends: DataFrame, docs: DataFrame) -> DataFrame:
    """Tables whose header ends in one chunk and whose rows go on in the next.

    Lines before and after each chunk end are counted from the text at hand; only their numbers meet the runs of rows.
    """
    cut = docs.join(ends.select("path").distinct(), "path", "left_semi")
    runs = table_runs(cut.select("path", "text", F.lit("any").alias("fmt")), ["path"])
    until = ends.select("path", "chunk_no", "end").join(docs.select("path", "text"), "path")
    # the line the end lies in, and whether it lies behind that line's last character
    line = F.regexp_count(F.left("text", F.col("end")), F.lit("\n"))
    done = (F.substr("text", F.col("end") + 1, F.lit(1)) == "\n") | (F.length("text") == F.col("end"))
    at = until.select("path", "chunk_no", line.cast("long").alias("line"), done.alias("done"))
    crossed = runs.join(at, "path").filter("(line > first_line or (line = first_line and done)) and (line < last_line or (line = last_line and not done))")
    return crossed.groupBy("path", "first_line", "header").agg(F.min("chunk_no").alias("chunk_no")).select("path", "first_line", T.clip("header", 80).alias("header"), "chunk_no")


EXAMPLES, PLACES = 3, 3


def findings(docs: DataFrame, spec: str = "langchain", vocabulary: str | None = None) -> DataFrame:
    """Cut conditions, headings and tables at the splitter's boundaries, one row per document and check."""
    _, how = splitter(spec, vocabulary)
    c = F.col
    ends = materialize(boundaries(docs, "path", spec, vocabulary), "boundaries")
    texts = docs.join(ends.select("path").distinct(), "path", "left_semi")
    example = F.concat(
        "place", F.lit(": chunk "), c("chunk_no").cast("string"), F.lit(" of "), c("n_chunks").cast("string"), F.lit(" keeps the claim, the condition '"), "qualifier", F.lit("' is only in the next:\n    “"),
        T.clip("left_part", 220, left=True), F.lit(" ✂ "), T.clip("right_part", 220), F.lit("”"),
    )
    split = cut_sentences(ends).withColumn("example", example).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "qualifier", "place", "example"))).alias("x"), F.count(F.lit(1)).alias("n"))
    quals, places = F.array_distinct(F.transform("x", lambda x: x.qualifier)), F.array_distinct(F.transform("x", lambda x: x.place))
    more = lambda n, k, what="more": F.when(n > k, F.concat(F.lit(" (+"), (n - k).cast("string"), F.lit(f" {what})"))).otherwise("")
    detail = F.concat(F.lit(f"Chunked with {how}. ✂ marks the end of a chunk.\n"), F.array_join(F.transform(F.slice("x", 1, EXAMPLES), lambda x: x.example), "\n"), more(c("n"), EXAMPLES))
    split = split.join(texts.select("path", T.rule_density("text").alias("density")), "path").select(*finding(
        "chunk-split", F.when(c("density") >= 10, "warn").otherwise("info"), ["F7"], F.concat(c("n").cast("string"), F.lit(" sentence(s) cut before their condition ("), F.array_join(F.slice(quals, 1, 3), ", "), F.lit(")")), c("path"),
        F.concat(F.array_join(F.slice(places, 1, PLACES), "; "), more(F.size(places), PLACES)), detail, fix="Split on sentences or attach neighbouring chunks.",
    ))
    heads = orphan_headings(ends, texts).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("chunk_no", "heading"))).alias("x"))
    listed = F.array_join(F.transform(F.slice("x", 1, EXAMPLES), lambda x: F.concat(F.lit("chunk "), x.chunk_no.cast("string"), F.lit(": "), x.heading)), "\n")
    heads = heads.select(*finding("chunk-orphan-heading", "info", ["F7"], F.format_string("%d heading(s) end a chunk", "n"), c("path"), detail=F.concat(listed, more(c("n"), EXAMPLES)), fix="Split on headings or repeat them in every chunk."))
    tables = split_tables(ends, texts).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("first_line", "header"))).alias("x"))
    listed = F.array_join(F.transform(F.slice("x", 1, EXAMPLES), lambda x: F.concat(F.lit("line "), (x.first_line + 1).cast("string"), F.lit(": "), x.header)), "\n")
    tables = tables.select(*finding("chunk-table-split", "info", ["F7"], F.format_string("%d table(s) cross a chunk boundary", "n"), c("path"), detail=F.concat(listed, more(c("n"), EXAMPLES)), fix="Keep tables whole or repeat their header."))
    return split.unionByName(heads).unionByName(tables)


def qualifier_of(words: Column) -> Column:
    """First qualifier of a few words, as Spark sees it; '' when there is none."""
    pattern = "(?i)(?<![A-Za-z0-9_'])(?:" + "|".join(q.replace(" ", f"[{T.SPACE}]+") for q in sorted(QUALIFIERS, key=lambda q: (-len(q), q))) + ")(?![A-Za-z0-9_'])(?!\\.[ \\t]*[0-9])"
    hits = F.filter(F.regexp_extract_all(words, F.lit(pattern), 0), lambda x: ~x.isin("No", "NO"))
    return F.lower(F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit("")))
