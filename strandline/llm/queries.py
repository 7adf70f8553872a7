"""The registered queries: each applies its operator to its whole table and derives the fixed result columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, chat, decontaminate, exact, lines, phrases, pii, quality, simhash, spelling, suffix, toxicity, urls
from strandline.llm.frames import table

WORD_BPE = "word_bpe_49k.json"


# The query's rules.
OP1_RULES = [
    urls.Rule("org", "/", "allow"),
    urls.Rule("example.org", "/es/", "block"),
    urls.Rule("example.org", "/en/1", "block"),
    urls.Rule("com", "/fr/", "allow"),
    urls.Rule("com", "/de/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url, by the longest rule or the host's trust and distrust."""
    return urls.judge_urls(table(spark, sf_dir, "pages"), OP1_RULES).withColumnRenamed("id", "page_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document of each group of equal texts stays, for all documents."""
    judged = exact.exact_dedup(table(spark, sf_dir, "documents"))
    return judged.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of documents that the benchmark has too; only documents with one have rows."""
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "first_word", "end_word", "equal_words"
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans by kind, and all spans with those the tagger adds."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find_spans(docs, pii.fit(docs))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda spans, kind: F.filter(spans, lambda s: s["kind"] == kind)
    count = lambda kind: F.size(of("base", kind)).cast("long").alias(f"n_{kind}")
    both = F.flatten(F.array(*(F.array_sort(of(F.concat("base", "added"), kind)) for kind in pii.KINDS)))
    return found.select(
        F.col("id").alias("doc_id"),
        *(count(kind) for kind in pii.KINDS),
        F.sha2(told("base"), 256).alias("base_sha256"),
        told(both).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model that the held-out fold has no part in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without runs of lines that an earlier place has too: three lines or 50 words."""
    found = lines.remove_repeated_lines(table(spark, sf_dir, "documents"))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda total, r: total + r["last"] - r["first"] + 1)
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("n_lines").cast("long").alias("n_lines"),
        removed.alias("n_removed"),
        F.size("runs").cast("long").alias("n_runs"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


# Every three lines are a window, and so are fewer with 50 words; all but a window's first by doc_id and line are copies.
OP6_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), w AS (
  SELECT doc_id, i, line, lead(line, 1) OVER d AS line2, lead(line, 2) OVER d AS line3,
         len(regexp_extract_all(line, '[^\x20\x09]+')) AS n
  FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), v AS (
  SELECT *, n + lead(n) OVER (PARTITION BY doc_id ORDER BY i) AS n2 FROM w
), f AS (
  SELECT doc_id, i, 3 AS size, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, i) > 1 AS again
  FROM v WHERE line3 IS NOT NULL
  UNION ALL
  SELECT doc_id, i, 2, row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, i) > 1
  FROM v WHERE line2 IS NOT NULL AND n2 >= 50
  UNION ALL
  SELECT doc_id, i, 1, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 FROM v WHERE n >= 50
), x AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS i FROM f WHERE again
), g AS (
  SELECT l.doc_id, l.i, l.line, CAST(x.i IS NOT NULL AS INT) AS gone
  FROM l LEFT JOIN x ON x.doc_id = l.doc_id AND x.i = l.i
), r AS (
  SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS starts FROM g
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone) AS BIGINT) AS n_removed,
       count(*) FILTER (starts) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone = 0), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the word tokenizer, and the text they decode to, as digests."""
    path = public_tokenizers.path(WORD_BPE)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.decode(bpe.encode(docs, path).select("doc_id", "ids"), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


# The query's shingle length.
OP8_WORDS = 4


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the group of near copies it is in."""
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"), OP8_WORDS)
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 400-byte strings that start elsewhere too."""
    found = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.length("kept") < F.col("n_bytes")).alias("removed"),
    )


def op9_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt, completions and learned spans of preference pairs.

    The table names no pairs, so conversations 2k and 2k + 1 are taken as chosen and rejected.
    """
    turns = table(spark, sf_dir, "conversations")
    couples = turns.filter("conv_id IS NOT NULL").groupBy(F.floor(F.col("conv_id") / 2)).agg(
        F.min("conv_id").alias("chosen_id"), F.max("conv_id").alias("rejected_id")
    )
    found = chat.preference_pairs(turns, couples.filter("chosen_id != rejected_id"))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(c)
    return found.select(
        "chosen_id", "rejected_id", "n_common", "prompt",
        "chosen_completion", told("chosen_spans"), "rejected_completion", told("rejected_spans"),
    )


# Turns as rows; a pair's prefix ends before the first turn number at which the two differ or one has none.
OP9_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS k
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id
), q AS (
  SELECT min(conv_id) AS chosen_id, max(conv_id) AS rejected_id FROM c
  GROUP BY floor(conv_id / 2) HAVING count(*) = 2
), m AS (
  SELECT chosen_id, rejected_id, min(k) - 1 AS n_common FROM (
    SELECT q.*, k FROM q JOIN t ON conv_id IN (chosen_id, rejected_id)
    GROUP BY ALL HAVING count(*) < 2 OR min(role) != max(role) OR min(text) != max(text)
  ) GROUP BY ALL
), r AS (
  SELECT q.*, coalesce(n_common, (SELECT n FROM c WHERE conv_id = q.rejected_id)) AS n_common
  FROM q LEFT JOIN m USING (chosen_id, rejected_id)
), s AS (
  SELECT conv_id, k, role, '<|' || role || '|>' || chr(10) || text || chr(10) AS turn_text,
         length(role) + 5 AS skip, length(text) AS size FROM t
), e AS (
  SELECT r.*, s.*, s.k > n_common AS ends, sum(CASE WHEN s.k > n_common THEN length(turn_text) ELSE 0 END)
    OVER (PARTITION BY chosen_id, rejected_id, conv_id ORDER BY k) - length(turn_text) AS pos0
  FROM r JOIN s ON s.conv_id IN (chosen_id, rejected_id)
)
SELECT chosen_id, rejected_id, CAST(n_common AS INT) AS n_common,
  coalesce(string_agg(turn_text, '' ORDER BY k) FILTER (conv_id = chosen_id AND NOT ends), '') AS prompt,
  coalesce(string_agg(turn_text, '' ORDER BY k) FILTER (conv_id = chosen_id AND ends), '') AS chosen_completion,
  coalesce(string_agg(CAST(pos0 + skip AS BIGINT) || ':' || CAST(pos0 + skip + size AS BIGINT), ',' ORDER BY k)
    FILTER (conv_id = chosen_id AND ends AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(turn_text, '' ORDER BY k) FILTER (conv_id = rejected_id AND ends), '') AS rejected_completion,
  coalesce(string_agg(CAST(pos0 + skip AS BIGINT) || ':' || CAST(pos0 + skip + size AS BIGINT), ',' ORDER BY k)
    FILTER (conv_id = rejected_id AND ends AND role = 'assistant'), '') AS rejected_spans
FROM e GROUP BY chosen_id, rejected_id, n_common
"""


# One run of letters in so many loses a letter; and a word's least length and count.
OP11_SLIP, OP11_LETTERS, OP11_COUNT = 97, 5, 3


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents, the form it is a variant of, and where forms end."""
    words = spelling.word_counts(table(spark, sf_dir, "documents"), OP11_SLIP, OP11_LETTERS).filter(F.col("n") >= OP11_COUNT)
    return spelling.spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model that the held-out fold has no part in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


# A phrase's least count, and the rows of each language.
OP13_LEAST, OP13_TOP = 100, 2000


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best phrases of two to five words."""
    return phrases.collocations(table(spark, sf_dir, "documents"), OP13_LEAST, OP13_TOP)


# Words by place in their piece; every run of up to five is a phrase's occurrence.
OP13_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), p AS (
  SELECT lang, unnest(regexp_extract_all(text, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM d
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p
), n AS (
  SELECT lang, CAST(sum(len(words)) AS HUGEINT) AS n FROM w GROUP BY lang
), s AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w
), o AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase
  FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(words)
), f AS (
  SELECT lang, phrase, k, count(*) AS a FROM o GROUP BY ALL HAVING count(*) >= 100
), c AS (
  SELECT f.*, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM f WHERE k > 1
), e AS (
  SELECT c.lang, c.phrase, c.k, c.a, x.a AS l, y.a AS r, n.n, cut,
         1000 * CAST(c.a AS HUGEINT) * n.n // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM c JOIN n USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ')
), b AS (
  SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), g AS (
  SELECT b.* FROM b WHERE NOT EXISTS (
    SELECT 1 FROM f z WHERE z.lang = b.lang AND z.k > b.k AND z.a >= b.a AND contains(' ' || z.phrase || ' ', ' ' || b.phrase || ' ')
  )
)
SELECT lang, row_number() OVER best AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM g WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER best <= 2000
"""


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_line_dedup": op6_line_dedup,
    "op7_bpe": op7_bpe,
    "op8_simhash": op8_simhash,
    "op9_preference": op9_preference,
    "op10_suffix_array": op10_suffix_array,
    "op11_spelling": op11_spelling,
    "op12_quality": op12_quality,
    "op13_phrases": op13_phrases,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": OP2_SQL,
    "op6_line_dedup": OP6_SQL,
    "op9_preference": OP9_SQL,
    "op13_phrases": OP13_SQL,
}
