"""HTML to text, headings and heading-aware chunks: the parts that need a parser, as Arrow-batched functions."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Elements whose content is left out, and those whose end begins a new paragraph.
SKIPPED = frozenset("script style nav header footer aside noscript svg".split())
BLOCKS = frozenset("p div li ul ol blockquote pre section article".split())
HEADINGS = {f"h{i}": i for i in range(1, 7)}


class _Reader(HTMLParser):
    """Text, headings and title.  A paragraph ends where a block element ends and on both sides of a heading; `br` is one line break."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skipping, self.pieces, self.headings, self.title = 0, [], [], None
        self._title, self._heading = None, None

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipping += 1
        elif self.skipping:
            return
        elif tag == "title":
            self._title = []
        elif tag == "br":
            self.pieces.append("\n")
        elif tag in HEADINGS:
            self._heading = (HEADINGS[tag], dict(attrs).get("id"), [])

    def handle_startendtag(self, tag, attrs):
        # an element without content: nothing opens that would have to end
        if tag not in SKIPPED:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skipping = max(0, self.skipping - 1)
        elif self.skipping:
            return
        elif tag == "title":
            self.title, self._title = "".join(self._title or []).strip() or None, None
        elif tag in HEADINGS:
            if self._heading:
                level, anchor, parts = self._heading
                if said := "".join(parts).strip():
                    self.headings.append((level, anchor, said))
                    self.pieces += ["\n\n", said, "\n\n"]
            self._heading = None
        elif tag in BLOCKS:
            self.pieces.append("\n\n")

    def handle_data(self, data):
        if self.skipping:
            return
        if self._title is not None:
            self._title.append(data)
        elif self._heading:
            self._heading[2].append(data)
        else:
            self.pieces.append(unescape(data))


def read_html(raw: str | None) -> tuple[str | None, str, list[tuple[int, str | None, str]]]:
    """(title, text, headings): runs of blanks and tabs become one space, more than one empty line becomes one; what is skipped leaves nothing."""
    reader = _Reader()
    reader.feed(raw or "")
    reader.close()
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", "".join(reader.pieces))).strip()
    return reader.title, text, reader.headings


def heading_chunks(text: str, headings: list[tuple[int, str | None, str]], target_tokens: int = 1500, overlap_tokens: int = 150) -> list[tuple[int, str, int, list[str]]]:
    """(first word, text, tokens, heading path) of each window; later windows start at the nearest paragraph start behind, within a tenth of the window."""
    if target_tokens <= overlap_tokens:
        raise ValueError("the target must exceed the overlap")
    all_words = text.split()
    size, lap = max(1, int(target_tokens * 0.75)), max(0, int(overlap_tokens * 0.75))
    starts, n = [0], 0
    for paragraph in re.split(r"\n{2,}", text):
        if count := len(paragraph.split()):
            starts.append(n)
            n += count
    places, at = [], 0
    for level, _, said in headings:
        own = said.split()
        hit = next((i for i in range(at, len(all_words) - len(own) + 1) if all_words[i] == own[0] and all_words[i : i + len(own)] == own), None) if own else None
        if hit is not None:
            places.append((hit, level, said))
            at = hit + len(own)
    out, cursor, passed, begin = [], 0, 0, -1
    path: dict[int, str] = {}
    while cursor < len(all_words):
        behind = starts[bisect_right(starts, cursor) - 1]
        # a window never begins where the last one did, however large the overlap
        begin = behind if out and cursor - behind <= max(1, size // 10) and behind > begin else cursor
        own = all_words[begin : begin + size]
        while passed < len(places) and places[passed][0] <= begin:
            _, level, said = places[passed]
            path = {k: v for k, v in path.items() if k < level} | {level: said}
            passed += 1
        out.append((begin, " ".join(own), max(1, round(len(own) / 0.75)), [path[k] for k in sorted(path)]))
        if begin + size >= len(all_words):
            break
        cursor = begin + max(1, size - lap)
    return out


#: Characters of the rows that leave a Python worker at once, pages that are unpacked at once, and bytes of a batch that comes to one.
OUT_CHARS, AT_ONCE, BATCH_BYTES = 1 << 20, 16, 4 << 20


def in_small_batches(rows: DataFrame, run: Callable[[dict], Iterable[dict]], schema: str) -> DataFrame:
    """run() over each row as a dict, which yields rows of the schema; a worker holds a few MB (or one row and what comes of it), however many or large the rows are."""
    conf = rows.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)).rstrip("bB")) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def each(batches):
        out, held = [], 0
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                for row in b.slice(at, AT_ONCE).to_pylist():
                    for made in run(row):
                        out.append(made)
                        held += 100 + sum(len(v) for v in made.values() if isinstance(v, str))
                        if held > OUT_CHARS:
                            yield pa.RecordBatch.from_pylist(out, schema=arrow)
                            out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(each, schema)


def parsed_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: Sequence[str] = ()) -> DataFrame:
    """(id, title, text, headings array<struct<level, anchor, said>>, error) for each page, and the columns to keep; a page that can't be parsed has `error` set."""

    def run(row):
        try:
            title, text, heads = read_html(row.pop("html"))
            yield row | {"title": title, "text": text, "headings": [{"level": a, "anchor": b, "said": c} for a, b, c in heads], "error": None}
        except Exception as e:  # one page's failure must not end the corpus
            yield row | {"title": None, "text": None, "headings": [], "error": str(e)[:200]}

    kept = "".join(f", `{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), *keep, F.col(html_col).alias("html"))
    return in_small_batches(rows, run, f"id long{kept}, title string, text string, headings array<struct<level:int,anchor:string,said:string>>, error string").withColumnRenamed("id", id_col)


def corpus_counts(pages: DataFrame, parsed: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(corpus, kept, skipped, failed) of pages (id, corpus, bearing): those that don't bear skills are skipped, those whose parse has an error failed."""
    told = pages.join(parsed.select(id_col, F.col("error")), id_col, "left")
    bad = F.col("error").isNotNull()
    return told.groupBy("corpus").agg(F.count_if(F.col("bearing") & ~bad).alias("kept"), F.count_if(~F.col("bearing")).alias("skipped"), F.count_if(F.col("bearing") & bad).alias("failed"))


def merged_counts(*parts: DataFrame) -> DataFrame:
    """(corpus, kept, skipped, failed, total, share) of corpus_counts() of several sites or clouds: counts of one corpus are added up."""
    every = reduce(DataFrame.unionByName, parts).groupBy("corpus").agg(*[F.sum(c).alias(c) for c in ("kept", "skipped", "failed")])
    total = F.col("kept") + F.col("skipped") + F.col("failed")
    return every.withColumn("total", total).withColumn("share", F.round(F.when(F.col("total") > 0, F.col("kept") / F.col("total")).otherwise(0.0), 6))


def page_chunks(parsed: DataFrame, id_col: str = "page_id", target_tokens: int = 1500, overlap_tokens: int = 150) -> DataFrame:
    """(id, chunk_index, starts_at_word, token_count, headings_path, chunk_text) of parsed pages."""

    def run(row):
        heads = [(h["level"], h["anchor"], h["said"]) for h in row["headings"] or ()]
        for i, (begin, said, tokens, path) in enumerate(heading_chunks(row["text"] or "", heads, target_tokens, overlap_tokens)):
            yield {"id": row["id"], "chunk_index": i, "starts_at_word": begin, "token_count": tokens, "headings_path": path, "chunk_text": said}

    rows = parsed.select(F.col(id_col).cast("long").alias("id"), "text", "headings")
    return in_small_batches(rows, run, "id long, chunk_index long, starts_at_word long, token_count long, headings_path array<string>, chunk_text string").withColumnRenamed("id", id_col)
