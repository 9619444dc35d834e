"""Fill-in-the-middle rearrangement of texts, in Spark SQL expressions alone.

A text is the array of its units (code points, unless another pattern is given) that
``regexp_extract_all`` finds. Two cuts come from the SHA-256 of the row's id: its
first two groups of eight hex digits, read by ``conv``, modulo the number of places.
``slice`` and ``array_join`` build prefix, middle and suffix, which are written behind
sentinels in the order prefix, suffix, middle (psm) or suffix, prefix, middle (spm);
the third and the fourth group choose whether and which. ``restored`` splits an output
at its sentinels and puts the parts back.

Everything depends on the row alone: no shuffle, no state. Defined cases: a null text
is empty; empty texts and texts that hold a sentinel stay as they are (plain); a null
id counts as an id without digits; repeated rows are cut alike, ties don't occur;
an empty table gives an empty table; other columns stay, those with the names of the
results give way. The units of one text lie in memory together, about 50 bytes each,
so a text of 10 million code points needs half a GB in its task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import small_batches

CODE_POINT = "(?s)."


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def pattern(self) -> str:
        """Any of the three, taken literally."""
        return "|".join(f"\\Q{s}\\E" for s in self.all)


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four whole numbers below 2**32: the first groups of eight digits of the hex SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def rearranged(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 90, spm: int = 20, seed: int = 1, unit: str = CODE_POINT, sentinels: Sentinels = Sentinels()
) -> DataFrame:
    """All columns of ``docs`` and n (units), form (plain, psm, spm), prefix_units, middle_units (null if plain) and output.

    rate: percent of the texts that are rearranged; spm: percent of those that put the suffix first; unit: a pattern whose
    matches make up the text, left to right (what it doesn't match is lost).
    """
    if not 0 <= rate <= 100 or not 0 <= spm <= 100:
        raise ValueError("rate and spm are percentages")
    small_batches(docs.sparkSession)
    made = ("n", "form", "prefix_units", "middle_units", "output")
    kept = [c for c in docs.columns if c not in made]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    h = draws(F.col(f"`{id_col}`"), seed)
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), text.alias("__text"), F.regexp_extract_all(text, F.lit(unit), 0).alias("__units"), F.array(*h).alias("__h"))
    h = [F.col("__h")[i] for i in range(4)]
    n = F.size("__units").cast("long")
    held = [F.contains("__text", F.lit(s)) for s in sentinels.all]
    plain = (n == 0) | held[0] | held[1] | held[2] | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    places = [h[i] % (n + 1) for i in range(2)]
    rows = rows.withColumns({"__n": n, "__form": form, "__a": F.least(*places).cast("int"), "__b": F.greatest(*places).cast("int")})
    a, b, n = F.col("__a"), F.col("__b"), F.col("__n")
    part = lambda begin, length: F.array_join(F.slice("__units", begin, length), "")
    parts = {sentinels.prefix: part(F.lit(1), a), sentinels.suffix: part(b + 1, n.cast("int") - b), sentinels.middle: part(a + 1, b - a)}
    ordered = lambda names: F.concat(*(x for s in names for x in (F.lit(s), parts[s])))
    psm, spm_order = (sentinels.prefix, sentinels.suffix, sentinels.middle), (sentinels.suffix, sentinels.prefix, sentinels.middle)
    output = F.when(F.col("__form") == "plain", F.col("__text")).when(F.col("__form") == "psm", ordered(psm)).otherwise(ordered(spm_order))
    cut = F.col("__form") != "plain"
    return rows.select(
        *(F.col(f"`{c}`") for c in kept), n.alias("n"), F.col("__form").alias("form"), F.when(cut, a.cast("long")).alias("prefix_units"), F.when(cut, (b - a).cast("long")).alias("middle_units"), output.alias("output")
    )


def restored(rows: DataFrame, output_col: str = "output", form_col: str = "form", name: str = "restored", sentinels: Sentinels = Sentinels()) -> DataFrame:
    """Adds the text that an output of ``rearranged`` was made from, read from the output and its form alone."""
    output, form = F.col(f"`{output_col}`"), F.col(f"`{form_col}`")
    split = rows.withColumn("__parts", F.when(form != "plain", F.split(output, sentinels.pattern(), -1)))
    first, second, third = (F.col("__parts")[i] for i in (1, 2, 3))
    text = F.when(form == "plain", output).when(form == "psm", F.concat(first, third, second)).otherwise(F.concat(second, third, first))
    return split.withColumn(name, text).drop("__parts")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of what is read back from it."""
    rows = restored(rearranged(docs.select("doc_id", "text")))
    sha = lambda c: F.sha2(c, 256).alias(f"{c}_sha256")
    return rows.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), sha("output"), sha("restored"))


_GROUP = "CAST('0x' || s[{}:{}] AS BIGINT) AS h{}"
#: DuckDB SQL for ``digests``.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT *, {", ".join(_GROUP.format(8 * i + 1, 8 * i + 8, i + 1) for i in range(4))} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, '<P>' || substring(t, 1, a) AS pre, '<M>' || substring(t, a + 1, b - a) AS mid, '<S>' || substring(t, b + 1, n - b) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN pre || suf || mid ELSE suf || pre || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
