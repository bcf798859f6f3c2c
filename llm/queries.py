"""The registered queries of the operators, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from llm import chat, exact_dedup, manifest, minhash_dedup, mixing, ngram_join, packing, pii, quality, spelling, suffix_dedup, token_counts, warc
from llm.common import table
from llm.encoding import vocabulary
from riskloom.runtime import scratch_path

#: Key of the surrogates; in production it comes from the deployment.
SURROGATE_KEY = "corpus-surrogates"
#: Sampling weight by labelled quality; documents without a label weigh 1.
QUALITY_WEIGHT = {0: 0.5, 1: 2.0}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived and read back."""
    path = scratch_path(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    back = warc.read_archive(spark, path)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def quality_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with a column ``_weight`` from the labels; of several labels of a document the worst counts."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_of")).agg(F.min("quality").alias("_quality"))
    weight = F.lit(1.0)
    for value, w in QUALITY_WEIGHT.items():
        weight = F.when(F.col("_quality") == value, w).otherwise(weight)
    return docs.join(known.hint("merge"), F.col("doc_id") == F.col("_of"), "left").withColumn("_weight", weight).drop("_of", "_quality")


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 1, 2, 3."""
    docs = table(spark, sf_dir, "documents").select("doc_id", mixing.n_words(F.col("text")).alias("size"), "source")
    weighted = quality_weights(docs, table(spark, sf_dir, "labels"))
    return mixing.mix(weighted, F.col("_weight"), size="size").select("doc_id", "size", "source_size", "target", "taken", "source", "epochs_taken")


@query
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by 3-word shingles at 90 %."""
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), width=3, percent=90)


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length histogram of all documents with what every context limit keeps."""
    return token_counts.length_histogram(token_counts.token_lengths(table(spark, sf_dir, "documents"), **vocabulary()))


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates in place of personal data and secrets."""
    return pii.pseudonymise(table(spark, sf_dir, "documents"), SURROGATE_KEY)


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return digested(packing.pack(table(spark, sf_dir, "documents"), **vocabulary()))


def digested(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the compression bands for every document."""
    return quality.quality(table(spark, sf_dir, "documents"))


@query
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that quotes control strings: logged, folded, rendered, read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoting = [(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]
    rows = rows.unionByName(spark.createDataFrame(quoting, "conv_id long, turn long, role string, text string"))
    messages = chat.fold(chat.events_of_rows(rows))
    return chat.digests(chat.read_back(chat.render(messages, F.col("msg.turn"))))


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without 200-byte strings that occur twice."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=200).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a leaf of the dataset's tree, with its proof, and tampered ones found out."""
    return manifest.document_manifest(table(spark, sf_dir, "documents"))


@query
def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by 4-word shingles at 80 %."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words and the form that they vary."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), spoil_every=199)


ORACLES["op1_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
o AS (SELECT h, max(page_id) AS owner FROM p WHERE payload_bytes >= 1000 GROUP BY h)
SELECT page_id, payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN owner IS NULL OR owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM p LEFT JOIN o ON p.h = o.h
"""

ORACLES["op9_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

def _sql_escape(text: str) -> str:
    """The SQL of :func:`llm.chat.escape`."""
    out = f"replace({text}, '\\', '\\\\')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLES["op8_chat"] = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
c AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    sum(length({_sql_escape("text")}) + length({_sql_escape("role")}) + {len(chat.TURN) + len(chat.END) + 2})::BIGINT AS formatted_chars
  FROM r GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c
"""

#: CRC-32 of the string column ``{0}`` bit by bit, on its UTF-8 bytes.
_CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen({0})), lambda i: ('0x' || substr(hex({0}), (2 * i + 1)::BIGINT, 2))::BIGINT)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
)


def _sql_part(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_sql_part(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


# every level of a tree is a list; the next one is made of its pairs, and a leaf's place halves from level to level
ORACLES["op11_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('+' || lang, '') AS grp, {_sql_leaf("n_chars")} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND {_CRC32.format("(doc_id::VARCHAR)")} % 7 = 0 THEN {_sql_leaf("(n_chars + 1)")} ELSE {_sql_leaf("n_chars")} END AS changed
  FROM documents
),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
levels AS (
  SELECT grp, 0 AS k, list(leaf ORDER BY pos) AS l FROM placed GROUP BY grp
  UNION ALL
  SELECT grp, k + 1, list_transform(range((len(l) + 1) // 2), lambda j: sha256(l[2 * j + 1] || coalesce(l[2 * j + 2], ''))) FROM levels WHERE len(l) > 1
),
tops AS (SELECT grp, l[1] AS subroot, k AS height, row_number() OVER (ORDER BY grp) - 1 AS pos FROM levels WHERE len(l) = 1),
upper AS (
  SELECT 0 AS k, list(subroot ORDER BY pos) AS l FROM tops
  UNION ALL
  SELECT k + 1, list_transform(range((len(l) + 1) // 2), lambda j: sha256(l[2 * j + 1] || coalesce(l[2 * j + 2], ''))) FROM upper WHERE len(l) > 1
),
steps AS (
  SELECT p.doc_id, p.leaf, p.changed, t.subroot, x.k AS step, (p.pos >> x.k) & 1 AS odd, x.l[xor(p.pos >> x.k, 1) + 1] AS sibling
  FROM placed p JOIN tops t ON p.grp = t.grp JOIN levels x ON x.grp = p.grp AND len(x.l) > 1
  UNION ALL
  SELECT p.doc_id, p.leaf, p.changed, t.subroot, t.height + u.k, (t.pos >> u.k) & 1, u.l[xor(t.pos >> u.k, 1) + 1]
  FROM placed p JOIN tops t ON p.grp = t.grp JOIN upper u ON len(u.l) > 1
),
paths AS (
  SELECT doc_id, leaf, changed, subroot, list(sibling ORDER BY step) AS siblings, list(odd ORDER BY step) AS odds FROM steps GROUP BY ALL
),
whole AS (
  SELECT * FROM paths
  UNION ALL
  SELECT p.doc_id, p.leaf, p.changed, t.subroot, [], [] FROM placed p JOIN tops t ON p.grp = t.grp WHERE NOT EXISTS (SELECT 1 FROM steps)
),
folding AS (
  SELECT doc_id, leaf, subroot, siblings, odds, 1 AS step, changed AS node FROM whole
  UNION ALL
  SELECT doc_id, leaf, subroot, siblings, odds, step + 1,
    sha256(CASE WHEN odds[step] = 1 THEN siblings[step] || node ELSE node || coalesce(siblings[step], '') END)
  FROM folding WHERE step <= len(siblings)
),
root AS (SELECT l[1] AS root FROM upper WHERE len(l) = 1)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_filter(siblings, lambda s: s IS NOT NULL), '')) AS proof_sha256,
  node AS folded_root, node = root AS verified
FROM folding, root WHERE step = len(siblings) + 1
"""

# words meet on what deleting one code point leaves, which is another way to the same neighbours
ORACLES["op13_spelling"] = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS doc, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run
  FROM documents
),
counted AS (SELECT doc, run, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY doc, run),
hashed AS (SELECT run, c, {_CRC32.format("(doc || run)")} AS h FROM counted),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, sum(c)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(c) >= 5
),
cuts AS (SELECT word, n, i, left(word, i::BIGINT) || substr(word, (i + 2)::BIGINT) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
),
near AS (
  SELECT w.word, w.n, count(p.other) AS n_near, first(p.other ORDER BY p.m DESC, p.other) AS best, first(p.m ORDER BY p.m DESC, p.other) AS best_n
  FROM words w LEFT JOIN pairs p ON w.word = p.word GROUP BY w.word, w.n
),
formed AS (SELECT word, n, n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM near),
walk AS (
  SELECT word, word AS place, form AS following FROM formed
  UNION ALL
  SELECT w.word, f.word, f.form FROM walk w JOIN formed f ON w.following = f.word
)
SELECT f.word, f.form, w.place AS root, f.n, f.n_near, f.form_n FROM formed f JOIN walk w ON f.word = w.word AND w.following IS NULL
"""
