"""Problem 2: texts that were cut inside a word or a sentence, found from the corpus's own word trigrams, in SQL.

A sentence's words are reduced to shapes where they name something (numbers, paths, capitalised names), so that one
pattern's trigrams count together. A trigram counts as *inside* where more words follow in the sentence, and as an *end*
where the sentence stops there. The final trigram of each text is joined to these counts: one that goes on in many
sentences but is almost never an end shows a cut. A cut may also fall inside a word; the final word then counts as each
longer word that begins with it, and where names stand as any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoria.session import cut_lineage, skew_join

FIELDS = ("description", "solution", "impact")
#: An end is real if at least this part of a trigram's occurrences are ends, both among different sentences, of which at
#: least MIN_ENDS end there, and among all copies, where no sentence counts as more than all others that end there.
END_PART = 0.1
MIN_ENDS = 3
#: Other sentences that show how a sentence goes on. One is enough: at 2, a tenth of the cut texts at sf0.01 and 4 % at sf0.1 would be lost.
MIN_INSIDE = 1
#: The same for the last two words, which are asked only where no other text goes on after the last three.
MIN_INSIDE_PAIR = 5
BOUNDED = "least({0}ends, 2 * ({0}ends - {0}most))"
IS_CUT = f"""CASE
  WHEN end_kinds >= {MIN_ENDS} AND end_kinds >= {END_PART} * (inside_kinds + end_kinds) AND {BOUNDED.format("")} >= {END_PART} * (inside + {BOUNDED.format("")}) THEN false
  WHEN inside_kinds - own >= {MIN_INSIDE} OR names >= {MIN_INSIDE} THEN true
  ELSE own = 0 AND pair_inside >= {MIN_INSIDE_PAIR} AND {BOUNDED.format("pair_")} < {END_PART} * (pair_inside + {BOUNDED.format("pair_")}) END"""

#: What a text has that isn't blank: anything but white space of any kind.
VISIBLE = r"(?U)\S"
#: Marks put where text was left out, and characters whose encoding was cut; they are no part of the sentence.
LEFT_OUT = r"(?:\s*(?:\[\s*)?(?:\.\.\.+|…)(?:\s*\])?|-|�|&\w{1,6})\s*$"

_SENTENCES = r"""
SELECT text, copies, pos = size(parts) - 1 AS final, trim(part) AS sentence
FROM (SELECT text, copies, split(regexp_replace(regexp_replace(regexp_replace(text, '(?U)^\\s+|\\s+$', ''), '@left_out@', ''), '([.!?]["\')\\]]*)\\s+(?=["\'(\\[]*\\p{{Lu}})', '$1\n'), '\n') AS parts FROM {texts})
LATERAL VIEW posexplode(parts) AS pos, part
WHERE part RLIKE '(?U)\\S'
"""

# a sentence's first word is kept, other capitalised words are names; words with digits or inner marks become their shape,
# in which A stands for letters that begin with a capital
_SHAPED = r"""
SELECT text, copies, final, sentence,
  split(regexp_replace(regexp_replace(array_join(concat(array('^', '^'), transform(filter(split(sentence, '\\s+'), w -> w <> ''), (w, i) -> CASE
    WHEN w RLIKE '[0-9/_@]|[.:-].' THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '0x[0-9a-f]+', '0x'), '\\p{{Lu}}\\p{{L}}*', 'A'), '\\p{{L}}+(?<!A)', 'a'), '[0-9]+', '#')
    WHEN i > 0 AND w RLIKE '^["\'(\\[]*\\p{{Lu}}' THEN concat('N', regexp_extract(w, '[^\\p{{L}}]*$', 0))
    ELSE lower(w) END)), ' '), '\\bN(?: N\\b)+', 'N'), '\\bN (?=#)', 'N'), ' ') AS words
FROM {sentences}
"""


def element_texts(df: DataFrame) -> DataFrame:
    """The distinct non-blank elements of the three fields, counted: ``text``, ``copies``. Copies are combined before the shuffle."""
    elements = F.concat(*(F.coalesce(F.col(f), F.array().cast("array<string>")) for f in FIELDS))
    return df.select(F.explode(elements).alias("text")).filter(F.col("text").rlike(VISIBLE)).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))


def last_texts(df: DataFrame, id_col: str = "seq") -> DataFrame:
    """``id``, ``source``, ``field``, ``text``: the last non-blank element of each record's fields."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("elements")) for f in FIELDS))
    rows = df.select(F.col(id_col).alias("id"), "source", F.explode(pairs).alias("p"))
    filled = F.filter("p.elements", lambda x: x.rlike(VISIBLE))
    return rows.select("id", "source", "p.field", F.element_at(F.when(F.size(filled) > 0, filled), -1).alias("text")).filter(F.col("text").isNotNull())


def final_trigrams(texts: DataFrame) -> DataFrame:
    """Each distinct ``text`` with its final trigram and how often that goes on and ends: ``inside``, ``ends``, and for its last two words.

    Counts cover all sentences of all texts, copies included; ``end_kinds`` and ``inside_kinds`` count different sentences only,
    and ``most`` is the copies of the one that ends there most often, as one text's copies say nothing on how others end. Sentences and counts are cut from their
    lineage, as several joins read them; both hold distinct values only.
    """
    spark = texts.sparkSession

    def step(sql: str, **frames: DataFrame) -> DataFrame:
        return spark.sql(sql, **frames)

    sentences = step(_SENTENCES.replace("@left_out@", LEFT_OUT.replace("\\", "\\\\").replace("{", "{{").replace("}", "}}")), texts=texts)
    shaped = cut_lineage(step(_SHAPED, sentences=sentences))
    # a stopped sentence ends with an end mark, or is the last of its text
    grams = cut_lineage(step(
        r"""
        SELECT g.w1, g.w2, g.w3, sum(CASE WHEN g.last THEN 0 ELSE copies END) AS inside,
          sum(CASE WHEN g.last THEN copies ELSE 0 END) AS ends, count_if(g.last) AS end_kinds, count_if(NOT g.last) AS inside_kinds, max(CASE WHEN g.last THEN copies ELSE 0 END) AS most
        FROM (SELECT any_value(words) AS words, sum(copies) AS copies FROM {shaped} GROUP BY sentence HAVING size(words) > 2)
        LATERAL VIEW explode(transform(sequence(2, size(words) - 1), i -> named_struct('w1', words[i - 2], 'w2', words[i - 1], 'w3', words[i], 'last', i = size(words) - 1))) AS g
        GROUP BY g.w1, g.w2, g.w3""",
        shaped=shaped,
    ))
    # own: how often the sentence has its last three words before; that alone doesn't show how others go on
    finals = step(
        """
        SELECT text, copies, w1, w2, w3, size(filter(sequence(2, n - 1), i -> i < n - 1 AND words[i] = w3 AND words[i - 1] = w2 AND words[i - 2] = w1)) AS own
        FROM (SELECT text, copies, words, size(words) AS n, words[size(words) - 3] AS w1, words[size(words) - 2] AS w2, words[size(words) - 1] AS w3 FROM {shaped} WHERE final AND size(words) > 2)""",
        shaped=shaped,
    )
    wanted = step("SELECT DISTINCT w1, w2, w3 FROM {finals}", finals=finals)
    # the beginnings of longer third words, for the cuts inside words: only where two wanted words stand before, and only as
    # long as wanted third words there. What a name is isn't seen before its digits, so N begins a shape too
    begun = step(
        r"""
        SELECT w1, w2, w3, sum(n) AS longer, sum(kinds) AS longer_kinds, sum(named) AS names FROM (
          SELECT g.w1, g.w2, explode(concat(transform(filter(p.sizes, k -> k < length(g.w3)), k -> left(g.w3, k)),
            CASE WHEN g.w3 RLIKE '^A[^A-Za-z]' THEN array('N', concat('N', substr(g.w3, 2, 1))) ELSE array() END,
            CASE WHEN g.w3 RLIKE '^[Aa][^A-Za-z]' THEN array('a name') ELSE array() END)) AS w3, inside + ends AS n, inside_kinds + end_kinds AS kinds, inside + ends AS named
          FROM {grams} g JOIN (SELECT w1, w2, collect_set(length(w3)) AS sizes FROM {wanted} GROUP BY w1, w2) p ON g.w1 = p.w1 AND g.w2 = p.w2)
        GROUP BY w1, w2, w3""",
        grams=grams, wanted=wanted,
    )
    triples = step(
        """
        SELECT w.w1, w.w2, w.w3, coalesce(g.inside, 0) + coalesce(b.longer, 0) AS inside, coalesce(g.ends, 0) AS ends, coalesce(g.end_kinds, 0) AS end_kinds,
          coalesce(g.inside_kinds, 0) + coalesce(b.longer_kinds, 0) AS inside_kinds, coalesce(g.most, 0) AS most
        FROM {wanted} w LEFT JOIN {grams} g ON w.w1 = g.w1 AND w.w2 = g.w2 AND w.w3 = g.w3
        LEFT JOIN {begun} b ON w.w1 = b.w1 AND w.w2 = b.w2 AND w.w3 = b.w3""",
        wanted=wanted, grams=grams, begun=begun,
    )
    pairs = step(
        """
        SELECT p.w2, p.w3, coalesce(g.inside, 0) + coalesce(b.longer, 0) AS inside, coalesce(g.ends, 0) AS ends, coalesce(g.most, 0) AS most
        FROM (SELECT DISTINCT w2, w3 FROM {wanted}) p
        LEFT JOIN (SELECT w2, w3, sum(inside) AS inside, sum(ends) AS ends, max(most) AS most FROM {grams} GROUP BY w2, w3) g ON p.w2 = g.w2 AND p.w3 = g.w3
        LEFT JOIN (SELECT w2, w3, sum(longer) AS longer FROM {begun} GROUP BY w2, w3) b ON p.w2 = b.w2 AND p.w3 = b.w3""",
        wanted=wanted, grams=grams, begun=begun,
    )
    # names are shapes once they are whole; the beginning of one is a plain word that stands where names do
    named = step("SELECT w1, w2, names FROM {begun} WHERE w3 = 'a name'", begun=begun)
    return step(
        "SELECT f.text, f.copies, f.w1, f.w2, f.w3, f.own, t.inside, t.ends, t.end_kinds, t.inside_kinds, t.most, p.inside AS pair_inside, p.ends AS pair_ends, p.most AS pair_most,"
        " CASE WHEN f.w2 <> '^' AND f.w3 RLIKE '^[\\\\p{{Ll}}]+$' THEN coalesce(n.names, 0) ELSE 0 END AS names FROM {finals} f"
        " JOIN {triples} t ON f.w1 = t.w1 AND f.w2 = t.w2 AND f.w3 = t.w3 JOIN {pairs} p ON f.w2 = p.w2 AND f.w3 = p.w3"
        " LEFT JOIN {named} n ON f.w1 = n.w1 AND f.w2 = n.w2",
        finals=finals, triples=triples, pairs=pairs, named=named,
    )


def cut_texts(texts: DataFrame) -> DataFrame:
    """The distinct ``text`` that were cut, and their ``copies``, by the counts of final_trigrams."""
    return final_trigrams(texts).filter(IS_CUT).select("text", "copies")


def truncated_values(df: DataFrame, id_col: str = "seq") -> DataFrame:
    """``id``, ``source``, ``field`` of each record's field whose text was cut.

    A field's text ends with its last non-blank element; null, empty and blank-only fields are not cut. Records and cut
    texts are joined by 128 bits of the text's digest; rows of a text that very many records share meet it where they are read.
    """
    # distinct texts are written first: else the optimiser infers a filter from the splitting and runs it on every copy
    texts = cut_lineage(element_texts(df))
    cut = cut_lineage(cut_texts(texts).select(F.unhex(F.md5("text")).alias("digest"), "copies"))
    rows = last_texts(df, id_col).select("id", "source", "field", F.unhex(F.md5("text")).alias("digest"))
    return skew_join(rows, cut, "digest", "copies", texts.agg(F.sum("copies")).first()[0] or 0).select("id", "source", "field")


def truncation_rates(df: DataFrame, id_col: str = "seq") -> DataFrame:
    """Per source and field: ``texts``, ``cut`` and ``cut_share``; a source without cut texts has 0."""
    texts = last_texts(df, id_col).groupBy("source", "field").agg(F.count(F.lit(1)).alias("texts"))
    cut = truncated_values(df, id_col).groupBy("source", "field").agg(F.count(F.lit(1)).alias("cut"))
    joined = texts.alias("t").join(cut.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")) & F.col("t.field").eqNullSafe(F.col("c.field")), "left")
    share = F.coalesce("c.cut", F.lit(0)) / F.col("t.texts")
    return joined.select("t.source", "t.field", "t.texts", F.coalesce("c.cut", F.lit(0)).alias("cut"), share.alias("cut_share"))
