"""Fill-in-the-middle: texts cut at two unit ranks found in an indexable skip list, and rebuilt from their parts."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.registry import query, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Links of a lane that one link of the lane above spans.
SPAN = 16
#: Code points that are looked at together.
PIECE = 1 << 20
#: Characters after which a task hands its rows on.
HANDED_ON = 4 << 20
#: Of 100 documents, so many are rearranged, and of those so many with the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20


class SkipList:
    """Units of a text, ``[A-Za-z]+`` or any other code point, in lanes of links from left to right.

    A link of the lowest lane passes one unit; a link of every higher lane passes ``SPAN`` links of the lane below (the
    last one what is left). Each link carries its width in units and in code points.
    """

    def __init__(self, text: str):
        starts, letter_before = [], False
        for at in range(0, len(text), PIECE):
            points = np.frombuffer(text[at:at + PIECE].encode("utf-32-le", "surrogatepass"), "<u4")
            folded = points | 32
            letter = (folded >= 97) & (folded <= 122)
            goes_on = letter & np.concatenate(([letter_before], letter[:-1]))
            starts.append(np.flatnonzero(~goes_on) + at)
            letter_before = bool(letter[-1])
        self.points = len(text)
        starts = np.concatenate([*starts, [self.points]]) if starts else np.zeros(1, np.int64)
        chars = np.diff(starts).astype(np.uint32)
        self.units = len(chars)
        self.lanes: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(len(chars), np.uint32), chars)]
        while len(self.lanes[-1][0]) > SPAN:
            first = np.arange(0, len(self.lanes[-1][0]), SPAN)
            self.lanes.append(tuple(np.add.reduceat(widths, first) for widths in self.lanes[-1]))

    def code_point(self, rank: int) -> int:
        """Code points before the unit of ``rank`` (0 to ``units``): from the highest lane down, links are followed as
        long as the units passed stay within the rank."""
        link = units = points = 0
        for k in range(len(self.lanes) - 1, -1, -1):
            unit_widths, point_widths = self.lanes[k]
            while link < len(unit_widths) and units + int(unit_widths[link]) <= rank:
                units, points = units + int(unit_widths[link]), points + int(point_widths[link])
                link += 1
            link *= SPAN if k else 1
        return points


@dataclass(frozen=True)
class Cut:
    """Number of units, form, the two cuts in code points (0 where plain) and the rearranged text."""

    units: int
    form: str
    first: int
    second: int
    output: str


def draws(doc_id: int | None) -> tuple[int, ...]:
    """Four numbers of 32 bits from the document's id; without an id from the empty string."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k:k + 4], "big") for k in (0, 4, 8, 12))


def rearrange(text: str | None, doc_id: int | None) -> Cut:
    """Cut the text between units at two drawn ranks and put the middle last.

    ``psm``: prefix, suffix, middle, each after its mark; ``spm``: suffix, prefix, middle. ``plain``, the text as it is:
    null (as empty) and empty texts, texts that hold a mark, and one of ten others.
    """
    text = text or ""
    listed, (h1, h2, h3, h4) = SkipList(text), draws(doc_id)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= REARRANGED:
        return Cut(listed.units, "plain", 0, 0, text)
    first, second = (listed.code_point(r) for r in sorted((h1 % (listed.units + 1), h2 % (listed.units + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < SUFFIX_FIRST:
        return Cut(listed.units, "spm", first, second, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle)
    return Cut(listed.units, "psm", first, second, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle)


def restore(output: str, form: str) -> str:
    """The text that ``rearrange`` was given, from its output and form alone. A mark cannot begin inside a part and end
    in the next mark, so the first one found is the one that was put there."""
    if form == "plain":
        return output
    mark = SUFFIX if form == "psm" else PREFIX
    second = output.index(mark, 3)
    third = output.index(MIDDLE, second + 3)
    parts = output[3:second], output[second + 3:third], output[third + 3:]
    prefix, suffix = parts[:2] if form == "psm" else (parts[1], parts[0])
    return prefix + parts[2] + suffix


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                    ("middle_chars", pa.int64()), ("output", pa.string())])
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` of every row of ``docs(doc_id, text)``: number of units,
    form, lengths of prefix and middle in code points (null where plain) and the rearranged text.

    Null texts are empty ones. Rows without ``doc_id`` draw as if it were the empty string; rows that repeat a
    ``doc_id`` are cut at the same draws, each in its own text. Very long texts are read in pieces, with four bytes a unit
    kept. Other columns are ignored, whatever their names. An empty table gives no rows.
    """

    def table_of(rows):
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                cut = rearrange(text.as_py(), doc_id)
                parts = (None, None) if cut.form == "plain" else (cut.first, cut.second - cut.first)
                rows.append((doc_id, cut.units, cut.form, *parts, cut.output))
                held += len(cut.output)
                if held > HANDED_ON:
                    yield table_of(rows)
                    rows, held = [], 0
        if rows:
            yield table_of(rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OUT)


def restored(cuts: DataFrame) -> DataFrame:
    """``cuts`` of ``fill_in_middle`` with ``text``, rebuilt from ``output`` and ``form`` by expressions: the parts between
    the marks."""
    at = lambda mark, after: F.expr(f"locate('{mark}', output, {after})")
    found = cuts.withColumn("_a", F.when(F.col("form") == "psm", at(SUFFIX, 4)).when(F.col("form") == "spm", at(PREFIX, 4)))
    found = found.withColumn("_b", F.expr(f"locate('{MIDDLE}', output, _a + 3)"))
    one, two, last = (F.expr(e) for e in ("substring(output, 4, _a - 4)", "substring(output, _a + 3, _b - _a - 3)", "substring(output, _b + 3)"))
    text = F.when(F.col("form") == "psm", F.concat(one, last, two)).when(F.col("form") == "spm", F.concat(two, last, one))
    return found.withColumn("text", F.coalesce(text, F.col("output"))).drop("_a", "_b")


SQL = r"""
with units as (
    select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u,
        sha256('1:' || coalesce(doc_id::varchar, '')) as h
    from documents
), drawn as (
    select doc_id, text, u, len(u) as n, ('0x' || substr(h, 1, 8))::bigint % (len(u) + 1) as r1,
        ('0x' || substr(h, 9, 8))::bigint % (len(u) + 1) as r2,
        ('0x' || substr(h, 17, 8))::bigint % 100 as h3, ('0x' || substr(h, 25, 8))::bigint % 100 as h4
    from units
), parts as (
    select *, array_to_string(u[1:least(r1, r2)], '') as p, array_to_string(u[least(r1, r2) + 1:greatest(r1, r2)], '') as m,
        array_to_string(u[greatest(r1, r2) + 1:], '') as s,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 >= 90 then 'plain'
             when h4 < 20 then 'spm' else 'psm' end as form
    from drawn
)
select doc_id, n::bigint as n, form,
    case when form <> 'plain' then length(p)::bigint end as prefix_chars,
    case when form <> 'plain' then length(m)::bigint end as middle_chars,
    sha256(case form when 'plain' then text when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m
                     else '<P>' || p || '<S>' || s || '<M>' || m end) as output_sha256,
    sha256(p || m || s) as restored_sha256
from parts
"""


@query("op12_fill_in_middle", SQL)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of the rearranged and of the rebuilt text of every document."""
    cuts = restored(fill_in_middle(table(spark, sf_dir, "documents")))
    return cuts.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(F.col("text"), 256).alias("restored_sha256"))
