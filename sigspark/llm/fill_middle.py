"""Fill-in-middle transformation by escaped marker injection, in DataFrame functions alone.

A delimiter that stands for "a unit ends here" is put behind each unit of a text by one ``regexp_replace``; where the
text itself holds the delimiter, it was escaped before.  Counting delimiters counts units, ``substring_index`` cuts the
marked text at the ranked ones, and each part loses its delimiters and is unescaped.  Nothing is shuffled: a row's
output depends on its text and id alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm import storage

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
SEED = 42
FIM_PERCENT = 50
SPM_PERCENT = 80

# Neither is white space, so escaping doesn't move the borders of units, and no pair is ever cut.
_END, _ESCAPE = "\x01", "\x02"
_ESCAPED = ((_ESCAPE, _ESCAPE + "0"), (_END, _ESCAPE + "1"))


def _index(text: Column, mark: str, count: Column | int) -> Column:
    """``substring_index`` whose count may be a column."""
    return F.call_function("substring_index", text, F.lit(mark), count if isinstance(count, Column) else F.lit(count))


def _escape(text: Column) -> Column:
    for plain, stored in _ESCAPED:
        text = F.replace(text, F.lit(plain), F.lit(stored))
    return text


def _unescape(part: Column) -> Column:
    part = F.replace(part, F.lit(_END), F.lit(""))
    for plain, stored in reversed(_ESCAPED):
        part = F.replace(part, F.lit(stored), F.lit(plain))
    return part


def marked(text: Column) -> Column:
    """The escaped text with a delimiter behind each unit."""
    return F.regexp_replace(_escape(text), UNIT, "$1" + _END)


def _between(text: Column, first: Column, last: Column, n: Column) -> Column:
    """Units after the ``first`` up to the ``last`` of the ``n`` of a marked text."""
    # A unit's end is a delimiter, so counted from the right there is one field more, which is empty.
    upto = _index(text, _END, last)
    return F.when(first >= last, F.lit("")).otherwise(F.when(last < n, _index(upto, _END, first - last)).otherwise(_index(text, _END, first - n - 1)))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: no part holds a marker, so the first of each kind is the one put in."""
    tail = _index(output, MIDDLE, -1)
    head = _index(output, MIDDLE, 1)
    psm = F.struct(F.substring(_index(head, SUFFIX, 1), len(PREFIX) + 1, 2**31 - 1).alias("prefix"), _index(head, SUFFIX, -1).alias("suffix"))
    spm = F.struct(_index(head, PREFIX, -1).alias("prefix"), F.substring(_index(head, PREFIX, 1), len(SUFFIX) + 1, 2**31 - 1).alias("suffix"))
    cut = F.when(form == "psm", psm).otherwise(spm)
    return F.when(form == "plain", output).otherwise(F.concat(cut["prefix"], tail, cut["suffix"]))


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of ``docs``.

    Form is ``plain`` (the text as it is), ``psm`` or ``spm``, by hashes of the seed and the id.  A null or empty text has
    no unit and stays plain, as an empty one; so does a text that holds a marker.  A null id hashes as an empty one.
    Equal rows give equal rows, an empty table gives none, and other columns, whatever their names, aren't read.  Texts
    of any length are taken whole.
    """
    rows = docs.select(storage.col(id_col).alias("doc_id"), F.coalesce(storage.col(text_col), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = rows.withColumn("h", F.transform(F.array(*(F.substring(digest, 8 * k + 1, 8) for k in range(4))), lambda x: F.conv(x, 16, 10).cast("long")))
    units = draws.withColumn("marked", marked(F.col("text")))
    units = units.withColumn("n", (F.char_length("marked") - F.char_length(F.replace("marked", F.lit(_END), F.lit("")))).cast("int"))
    one, two = ((F.col("h")[k] % (F.col("n") + 1)).cast("int") for k in range(2))
    units = units.withColumns({"first": F.least(one, two), "last": F.greatest(one, two)})
    held = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | held | (F.col("h")[2] % 100 >= fim_percent)
    units = units.withColumn("form", F.when(plain, "plain").when(F.col("h")[3] % 100 < spm_percent, "spm").otherwise("psm"))
    part = lambda a, b: F.when(F.col("form") != "plain", _unescape(_between(F.col("marked"), a, b, F.col("n"))))
    zero, first, last, n = F.lit(0), F.col("first"), F.col("last"), F.col("n")
    cut = units.withColumns({"prefix": part(zero, first), "middle": part(first, last), "suffix": part(last, n)})
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return cut.select("doc_id", F.col("n").cast("long").alias("n"), "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"), output.alias("output"))
