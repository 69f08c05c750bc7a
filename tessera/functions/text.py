"""Text forms of cell values, names, tables, tiles and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_PATTERN = r"(\w+|[^\w\s])"
CODE_FENCE = "```csv"


def value_text(column: Column, data_type: T.DataType) -> Column:
    """A cell value as text, null for null.

    Doubles are written as a dataframe prints them: plain from 1e-4 to 1e16 (``12345678.5``, not ``1.23456785E7``),
    with a two-digit exponent elsewhere (``1e-05``, ``1.5e+16``).
    """
    text = column.cast("string")
    if not isinstance(data_type, (T.DoubleType, T.FloatType)):
        return text
    size = F.abs(column)
    # the rare forms stand in a lambda: written out for every column, they make the code of a table too long to compile
    rare = F.transform(F.array(column), _rare_number)[0]
    return F.when((size >= 1e-3) & (size < 1e7), text).otherwise(rare)


def _rare_number(column: Column) -> Column:
    text, size = column.cast("string"), F.abs(column)
    without_zeros = lambda digits: F.regexp_replace(digits, r"0+$", "")
    plain = without_zeros(column.cast("decimal(38,10)").cast("string"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    small = without_zeros(text.cast("decimal(38,28)").cast("string"))
    power = F.regexp_extract(text, "E(-?)([0-9]+)$", 2)
    sign = F.when(text.contains("E-"), "e-").otherwise("e+")
    short = F.concat(F.regexp_extract(text, r"^(-?[0-9]+(?:\.[0-9]*[1-9])?)", 1), sign, F.lpad(power, 2, "0"))
    short = F.when(F.length(power) > 2, F.concat(F.regexp_extract(text, r"^(-?[0-9]+(?:\.[0-9]*[1-9])?)", 1), sign, power)).otherwise(short)
    return (
        F.when((size >= 1e7) & (size < 1e16), plain)
        .when((size >= 1e-4) & (size < 1e-3), small)
        .when(((size < 1e-4) & (size > 0)) | ((size >= 1e16) & (size < float("inf"))), short)
        .otherwise(text)
    )


def embedding_text(value: Column) -> Column:
    """The text of a cell as the embedder sees it: nulls become ``nan``."""
    return F.coalesce(value, F.lit("nan"))


def normalize_name(name: Column, enabled: bool = True) -> Column:
    """Replace ``-`` and ``_`` in table and column names by spaces."""
    return F.translate(name, "-_", "  ") if enabled else name


def truncate_value(value: Column, max_length: int = 30) -> Column:
    return F.substring(value, 1, max_length)


def csv_field(value: Column) -> Column:
    """One CSV field with minimal quoting; null becomes an empty field."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.isNull(), F.lit("")).when(value.rlike('[",\\r\\n]'), quoted).otherwise(value)


def csv_line(fields: list[Column]) -> Column:
    """Fields joined to one CSV line. A lone empty field is written as ``""``."""
    parts = [csv_field(f) for f in fields]
    line = F.concat_ws(",", *parts)
    if len(fields) == 1:
        return F.when(line == "", F.lit('""')).otherwise(line)
    return line


def csv_line_of_array(values: Column) -> Column:
    # fields that need quotes are rare: one look at all of them together, and only then one at each
    plain = ~F.array_join(values, "").rlike('[",\\r\\n]')
    line = F.when(plain, F.array_join(values, ",", "")).otherwise(F.array_join(F.transform(values, csv_field), ","))
    return F.when((F.size(values) == 1) & (line == ""), F.lit('""')).otherwise(line)


def tile_text(table_name: Column, csv_text: Column) -> Column:
    """``table: "<name>"``, a blank line, the CSV text and a final newline."""
    return F.concat(F.lit('table: "'), table_name, F.lit('"\n\n'), csv_text, F.lit("\n"))


def list_answer(values: Column) -> Column:
    return F.array_join(values, ",")


def answer_columns(answer_table: Column) -> Column:
    return F.array_join(F.map_keys(answer_table), ", ")


def answer_text(answer_table: Column) -> Column:
    """An answer ``MAP<column name, ARRAY<value>>`` as CSV, its columns in map order."""
    values = F.map_values(answer_table)
    n = F.coalesce(F.array_max(F.transform(values, F.size)), F.lit(0))
    rows = F.transform(
        F.filter(F.sequence(F.lit(0), n), lambda i: i < n), lambda i: csv_line_of_array(F.transform(values, lambda v: F.get(v, i))))
    lines = F.concat(F.array(csv_line_of_array(F.map_keys(answer_table))), rows)
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


#: A CSV field with what ends it: quoted (doubled quotes and line breaks belong to it) or plain up to a comma or line end.
_FIELD = r'(?s)(?:"(?:[^"]++|"")*+"?[^,\r\n]*+|[^,\r\n"][^,\r\n]*+|)(?:,|\r\n|\n|\r|$)'
_LINE_END, _OPEN_QUOTE = r"[\r\n]$", r'(?s)^"(?:[^"]++|"")*+$'


def _without_fence(prediction: Column) -> Column:
    fenced = prediction.startswith(CODE_FENCE)
    return F.when(fenced, F.substring(prediction, F.lit(7), F.length(prediction) - F.lit(9))).otherwise(prediction)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def csv_records(text: Column) -> Column:
    """Raw fields of every line of a CSV text that is not blank: quotes and the fields' ends are still there.

    One pass of a pattern cuts fields with what ends them; the fields that end with a line end close a record.
    """
    closed = F.concat(F.regexp_replace(text, r"[\r\n]+\z", ""), F.lit("\n"))

    def lines(fields: Column) -> Column:
        n = F.size(fields) - 1  # the last match is the empty one at the end of the text
        numbers = F.filter(F.sequence(F.lit(0), n), lambda i: i > 0)
        ends = F.filter(numbers, lambda i: F.element_at(fields, i).rlike(_LINE_END) | (i == n))
        return _let(ends, lambda e: F.transform(e, lambda end, k: F.slice(
            fields, F.when(k == 0, 1).otherwise(F.get(e, k - 1) + 1), end - F.when(k == 0, 0).otherwise(F.get(e, k - 1)))))

    records = _let(F.regexp_extract_all(closed, F.lit(_FIELD), F.lit(0)), lines)
    return F.filter(records, lambda r: ~((F.size(r) == 1) & (F.trim(F.regexp_replace(r[0], r"[\t\r\n]", "")) == "")))


def csv_value(field: Column) -> Column:
    """A raw field of ``csv_records`` without its end and its quotes."""
    bare = F.regexp_replace(field, r"(?:,|\r\n|\n|\r)\z", "")
    inner = F.replace(F.regexp_extract(bare, r'(?s)^"((?:[^"]++|"")*+)"', 1), F.lit('""'), F.lit('"'))
    after = F.regexp_extract(bare, r'(?s)^"(?:[^"]++|"")*+"(.*)$', 1)
    return F.when(bare.startswith('"'), F.concat(inner, after)).otherwise(bare)


def _parses(records: Column) -> Column:
    wide = F.exists(records, lambda r: F.size(r) > F.size(records[0]))
    return (F.size(records) > 0) & ~wide & ~F.exists(records, lambda r: F.exists(r, lambda f: f.rlike(_OPEN_QUOTE)))


def prediction_parses(prediction: Column) -> Column:
    """Whether a prediction reads as CSV: it has a header, no line has more fields than it, and quotes are closed."""
    return _let(csv_records(_without_fence(prediction)), _parses)


def _column_names(names: Column) -> Column:
    """Names of columns as a dataframe gives them: ``Unnamed: 2`` for an empty third one, ``x.1`` for the second ``x``."""
    earlier = lambda x, i: F.size(F.filter(names, lambda y, j: (j < i) & (y == x)))
    return F.transform(names, lambda x, i: F.when(x == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).when(
        earlier(x, i) > 0, F.concat_ws(".", x, earlier(x, i).cast("string"))).otherwise(x))


def clean_prediction(prediction: Column) -> Column:
    """A prediction as CSV is written here: without code fence, quotes only where needed, ``\\n`` line ends, no blank lines,
    short lines filled up with empty fields. Quoted fields may hold commas, quotes, line breaks and blank lines.

    What does not read as CSV is kept as it is, without the fence.
    """
    def written(records: Column) -> Column:
        def line(r: Column, k: Column) -> Column:
            missing = F.array_repeat(F.lit(""), F.size(records[0]) - F.size(r))
            values = F.concat(F.transform(r, csv_value), missing)
            return csv_line_of_array(F.when(k == 0, _column_names(values)).otherwise(values))

        return F.when(_parses(records), F.concat(F.array_join(F.transform(records, line), "\n"), F.lit("\n")))

    body = _without_fence(prediction)
    return F.coalesce(_let(csv_records(body), written), body)


def token_count(text: Column) -> Column:
    """Number of word and punctuation tokens. Any ``Column -> Column`` may stand in for it."""
    return F.regexp_count(text, F.lit(TOKEN_PATTERN))


def truncate_tokens(text: Column, limit: int) -> Column:
    """The text up to and including its first ``limit`` tokens, spacing between them kept."""
    pieces = F.regexp_extract_all(text, F.lit(r"(\s*(?:\w+|[^\w\s]))"), F.lit(1))
    return F.array_join(F.slice(pieces, 1, limit), "")


def message_tokens(text: Column, per_message: int = 10) -> Column:
    """Tokens a chat message is charged: its text plus a fixed surcharge."""
    return token_count(text) + F.lit(per_message)


def config_map(config_name: Column) -> Column:
    """``k=v_k=v`` as a map; a value that holds ``_`` does not survive, as in the naming scheme itself."""
    last = F.element_at(F.split(config_name, "/"), -1)
    return F.str_to_map(last, F.lit("_"), F.lit("="))
