"""One query per operator over the driver's tables, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quotelake.llm.block_naming import exact_duplicates
from quotelake.llm.bpe_stream import bpe_round_trip
from quotelake.llm.byte_cnn import learn_quality, score_quality
from quotelake.llm.conversation_trie import conversation_trie
from quotelake.llm.group_join import near_duplicates
from quotelake.llm.line_rules import line_quality
from quotelake.llm.packing import pack
from quotelake.llm.passage_dedup import remove_repeats
from quotelake.llm.pseudonyms import pseudonym_report
from quotelake.llm.secret_forest import scan_secrets
from quotelake.llm.tables import table
from quotelake.llm.token_alignment import align_tokenizers
from quotelake.llm.token_counts import token_counts
from quotelake.llm.token_store import stored_tokens

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"
KEY = b"quotelake demonstration key"  # users pass their own

_FOLD = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"


def op1_byte_cnn_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, learn_quality(docs, table(spark, sf_dir, "labels")))


def op2_secret_forest(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "word_no", "part", F.sha2("candidate", 256).alias("candidate_sha256"),
                        F.length("candidate").alias("length"), "score", "is_secret")


def op3_token_store(spark, sf_dir):
    return stored_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op4_bpe_round_trip(spark, sf_dir):
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op5_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op6_group_prefix_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=85)


def op7_pseudonyms(spark, sf_dir):
    return pseudonym_report(table(spark, sf_dir, "documents"), KEY)


def op8_line_quality(spark, sf_dir):
    return line_quality(table(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op10_exact_duplicates(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op11_fm_substring_dedup(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents"), width=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_spill_alignment(spark, sf_dir):
    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE),
                            public_tokenizers.path(PIECE_BPE))


def op13_sequence_trie(spark, sf_dir):
    return conversation_trie(table(spark, sf_dir, "conversations"))


_STOPS = ".!?:;…。！？；："
_LINE_FAILS = rf"""
    100 * (len(list_filter(own, lambda x: x = '|')) + len(list_filter(own[2:], lambda x: x IN ('>', '»', '›', '•', '·')))) > 20 * len(own)
    OR 100 * (length(line) - length(translate(line, '#*$%&|<>', ''))) > 10 * chars
    OR 100 * len(list_filter(own, lambda x: ends_with(x, '!!'))) > 30 * len(own)
    OR (letters >= 10 AND 100 * length(regexp_replace(line, '[^A-Z]', '', 'g')) > 60 * letters)
    OR (len(own) > 1 AND 100 * len(list_filter(own, lambda x, i: i > 1 AND x = own[i - 1])) > 50 * (len(own) - 1))
    OR (len(own) > 100 AND stops = 0)
    OR (len(own) >= 10 AND NOT regexp_matches(own[-1], '[{_STOPS}]["'')\]”’»]*$') AND 40 * stops < len(own)
        AND NOT regexp_matches(coalesce(after, ''), '^[\x20\x09-\x0D]*[a-zß-öø-ÿ]'))
    OR greatest(sum(short) OVER (o ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), sum(short) OVER (o ROWS BETWEEN 1 PRECEDING
        AND 1 FOLLOWING), sum(short) OVER (o ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) = 3
    OR regexp_matches({_FOLD.format('line')},
        'lorem ipsum|all rights reserved|cookie policy|privacy policy|terms of use|enable javascript')"""

LINE_QUALITY = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format('text')} AS words FROM documents),
u AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
g AS (SELECT doc_id, pos, CASE WHEN lead(word, 7) OVER o IS NOT NULL THEN concat_ws(' ', word, {", ".join(
    f"lead(word, {i}) OVER o" for i in range(1, 8))}) END AS gram FROM u
    WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, CAST(gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS INTEGER) AS again
    FROM g),
c AS (SELECT doc_id, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit
    FROM r),
n AS (SELECT doc_id, CAST(sum(hit) AS BIGINT) AS n_repeat_words FROM c GROUP BY doc_id),
s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM w),
l AS (SELECT doc_id, line, pos, {_WORDS.format('line')} AS own, length(array_to_string(own, '')) AS chars,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again,
    lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS after,
    length(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS letters,
    length(line) - length(translate(line, '{_STOPS}', '')) AS stops,
    CAST(len(own) <= 4 AND NOT regexp_matches(line, '[{_STOPS},、，]') AS INTEGER) AS short FROM s),
v AS (SELECT doc_id, chars, again, {_LINE_FAILS} AS fails FROM l WHERE len(own) > 0
    WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
j AS (SELECT doc_id, CAST(count(*) FILTER (WHERE again) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(sum(chars) FILTER (WHERE again OR fails), 0) AS BIGINT) AS lost_chars
    FROM v GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(lost_chars, 0) AS lost_chars FROM w LEFT JOIN n USING (doc_id) LEFT JOIN j USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * lost_chars <= 50 * word_chars AS kept FROM f"""

EXACT_DUPLICATES = f"""
WITH t AS (SELECT doc_id, {_FOLD.format('text')} AS folded FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(folded) AS text_sha256
FROM t WINDOW g AS (PARTITION BY folded)"""

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS words FROM documents),
u AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
g AS (SELECT doc_id, pos, word, CASE WHEN lead(word, 12) OVER o IS NOT NULL THEN concat_ws(' ', word, {", ".join(
    f"lead(word, {i}) OVER o" for i in range(1, 13))}) END AS gram FROM u
    WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, word, CAST(gram IS NOT NULL AND min(doc_id) OVER (PARTITION BY gram) < doc_id AS INTEGER) AS again
    FROM g),
c AS (SELECT doc_id, pos, word, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING
    AND CURRENT ROW) AS gone FROM r),
n AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed,
    string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN n USING (doc_id)"""

# crc32 of the decimal number: 0xEDB88320 is the reflected polynomial
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
    range(1, length(c::VARCHAR) + 1), lambda i: ascii((c::VARCHAR)[i])::BIGINT)), lambda crc, byte: list_reduce(
    list_prepend(xor(crc, byte), [1::BIGINT, 1, 1, 1, 1, 1, 1, 1]),
    lambda x, one: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)::BIGINT)))"""

SEQUENCE_TRIE = f"""
WITH t AS (SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST)
    AS own FROM conversations GROUP BY conv_id),
h AS (SELECT c, own, ({_CRC} % 6)::BIGINT AS h FROM t),
r AS (SELECT h.c, list_concat(coalesce(b.own, [])[1:h.h], h.own[h.h + 1:]) AS seq
    FROM h LEFT JOIN t AS b ON b.c = h.c - h.c % 100),
p AS (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS depth FROM r),
n AS (SELECT depth, seq[1:depth] AS prefix, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(seq) = depth), '')) AS ends_sha256
    FROM p GROUP BY ALL),
k AS (SELECT depth - 1 AS depth, prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN depth > 0 THEN (n_convs - 1) * length(prefix[depth].text) ELSE 0 END AS value
    FROM n LEFT JOIN k USING (depth, prefix)),
u AS (SELECT unnest(range(0, depth + 1)) AS top, prefix, value, n_children FROM v),
s AS (SELECT top AS depth, prefix[1:top] AS prefix, CAST(sum(value) AS BIGINT) AS saved_tokens,
    count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM u GROUP BY ALL)
SELECT v.conv_id, v.depth, o.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM v JOIN s USING (depth, prefix) LEFT JOIN n AS o ON o.depth = v.depth - 1 AND o.prefix = v.prefix[1:v.depth - 1]"""

QUERIES = {f.__name__: f for f in (
    op1_byte_cnn_quality, op2_secret_forest, op3_token_store, op4_bpe_round_trip, op5_best_fit_packing,
    op6_group_prefix_join, op7_pseudonyms, op8_line_quality, op9_token_counts, op10_exact_duplicates,
    op11_fm_substring_dedup, op12_spill_alignment, op13_sequence_trie)}
ORACLES = {"op8_line_quality": LINE_QUALITY, "op10_exact_duplicates": EXACT_DUPLICATES,
           "op11_fm_substring_dedup": SUBSTRING_DEDUP, "op13_sequence_trie": SEQUENCE_TRIE}
