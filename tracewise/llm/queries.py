"""Queries of this folder: name -> (spark, sf_dir) -> DataFrame, and SQL where SQL can express them."""

from __future__ import annotations

import secrets
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from tracewise.llm.shared import table

#: Setting with the key of the keyed permutations and digests (Spark redacts settings named so).
KEY_SETTING = "spark.tracewise.pii.secret"


@cache
def _random_key() -> str:
    return secrets.token_hex(32)


def pii_key(spark: SparkSession) -> str:
    """The key that is set; else a random one that this process keeps to itself: values stay linked within it, and nobody can undo them later."""
    return spark.conf.get(KEY_SETTING, None) or spark.sparkContext.getConf().get(KEY_SETTING) or _random_key()


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewise.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), emit="digests")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewise.llm.lines import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewise.llm.classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewise.llm.rules import score

    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=("doc_id",))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewise.llm.suffixes import dedup_bytes

    return dedup_bytes(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewise.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewise.llm.pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewise.llm.chat import digests, with_probe

    return digests(with_probe(table(spark, sf_dir, "conversations")))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewise.llm.media import media_digests

    return media_digests(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewise.llm.jaccard import join

    return join(table(spark, sf_dir, "documents"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewise.llm.decontamination import digests, find

    return digests(find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewise.llm.collocations import mine

    return mine(table(spark, sf_dir, "documents"))


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewise.llm.ranking import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_encode_decode": op1_bpe_encode_decode,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_quality_rules": op4_quality_rules,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_packing": op6_packing,
    "op7_pii": op7_pii,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_media_columns": op9_media_columns,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_benchmark_decontamination": op11_benchmark_decontamination,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_ranked_lexical_search": op13_ranked_lexical_search,
}

#: Words of a text: A-Z as a-z, then runs of letters, digits and characters beyond ASCII.
_PLAIN = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL: dict[str, str] = {
    "op11_benchmark_decontamination": f"""
with d as (select doc_id, coalesce({_PLAIN}, []) as w from documents),
i as (select cast(item_id as varchar) as item_id, {_PLAIN} as w from benchmark),
windows as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[k : k + 9], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k from i where len(w) > 0)),
sizes as (select distinct n from windows),
grams as (select doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, sizes)),
found as (select doc_id, k, n, item_id from grams join windows using (n, g)),
hit as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(k, k + n)) as place from (select distinct doc_id, k, n from found)) group by doc_id),
own as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id from found) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join hit using (doc_id) left join own using (doc_id)""",
    "op12_phrase_collocations": r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
total as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
grams as (select lang, size, array_to_string(w[k : k + size - 1], ' ') as phrase
  from (select lang, w, size, unnest(range(1, len(w) - size + 2)) as k from w, (values (1), (2), (3)) as s(size))),
f as (select lang, size, phrase, count(*) as n from grams group by all having count(*) >= 10),
own as (select lang, phrase, size, n as a, string_split(phrase, ' ') as w from f where size > 1),
cut as (select lang, phrase, size, a, w, unnest(range(1, size)) as k from own),
cuts as (
  select c.lang, c.phrase, c.a, c.k, x.n as l, y.n as r, (1000000::hugeint * c.a * c.a) // (x.n::hugeint * y.n) as score
  from cut c join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1 : c.k], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k + 1 : c.size], ' ')),
worst as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
longer as (select lang, phrase, max(a) as a from (select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase from own where size = 3) group by all),
kept as (select w.* from worst w left join longer x using (lang, phrase) where x.a is null or 100 * x.a < 50 * w.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score from ranked join total using (lang) where rank <= 2000""",
    "op13_ranked_lexical_search": f"""
with d as (select doc_id, unnest({_PLAIN}) as term from documents),
tf as (select doc_id, term, count(*) as tf from d group by all),
lengths as (select doc_id, sum(tf)::bigint as n from tf group by doc_id),
total as (select count(*) as docs, sum(n)::bigint as words from lengths),
weights as (select term, cast(floor(1000 * ln((2.0::double * docs + 2) / (2.0::double * count(*) + 1))) as bigint) as w from tf, total group by term, docs),
q as (select item_id, term, count(*) as times from (select item_id, unnest({_PLAIN}) as term from benchmark) group by all),
scored as (
  select item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) as bigint) as score
  from q join weights using (term) join tf using (term) join lengths using (doc_id), total group by item_id, doc_id),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scored where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10""",
}
