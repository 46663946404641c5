"""Thin queries ``opN_<name>`` over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _scratch, crf, decontam, fim, itq, kneser_ney, langid, linecrf, mixing, pii, simhash, tokens, vafile, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(_table(spark, sf_dir, "embeddings")).drop("code")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _scratch.new_path(spark, "warc")
    return warc.read_archives(warc.normalise(warc.write_archives(_table(spark, sf_dir, "pages"), folder))).drop("offset", "length")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    found = crf.toxicity(docs, labels, id_remainder(3) != 1)
    return found.withColumn("held_out", id_remainder(3) == 1)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, id_remainder(5) != 0)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", (id_remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = tokens.write_tokens(
        _table(spark, sf_dir, "documents"), _scratch.new_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2, added=True
    )
    return tokens.read_tokens(spark, manifest)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = kneser_ney.fit(docs, id_remainder(10) != 0)
    scored = kneser_ney.score(docs, model).withColumnRenamed("id", "doc_id").withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return scored.withColumn("held_out", id_remainder(10) == 0)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vafile.compress(_table(spark, sf_dir, "embeddings"))
    found = vafile.with_label_error(coded).withColumn("codebooks_sha256", F.lit(vafile.digest(books)))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.fill_in_middle(_table(spark, sf_dir, "documents"))
    return cut.select(
        *("doc_id", "n", "form", "prefix_chars", "middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    field = linecrf.fit(docs, _table(spark, sf_dir, "labels"))
    return linecrf.quality(linecrf.label_lines(docs, field)).drop("boilerplate")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_language_id": op4_language_id,
    "op5_mixing": op5_mixing,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_pii": op7_pii,
    "op8_decontamination": op8_decontamination,
    "op9_token_output": op9_token_output,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_vector_codes": op11_vector_codes,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_quality_rules": op13_quality_rules,
}

_OP1 = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
 reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
 least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
 SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least ON least.a = vec_id"""

_HEX = "(strpos('0123456789abcdef', substr(h, (5 * k) // 4 + {i}, 1)) - 1)"
_OP2 = f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least FROM p)
 SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((((16 * {_HEX.format(i=1)} + {_HEX.format(i=2)}) >> (3 - (5 * k) % 4)) & 31) + 1), 1)), '') AS payload_digest,
 CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to FROM f"""

_OP5 = r"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM s),
 w AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM p),
 l AS (SELECT *, (total - coalesce(sum(most) OVER earlier, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) * weight >= most AS is_full FROM w
  WINDOW earlier AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 t AS (SELECT source, source_size, CASE WHEN is_full THEN most ELSE weight * ((total - sum(CASE WHEN is_full THEN most ELSE 0 END) OVER ()) / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ()) END AS target FROM l),
 b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
 o AS (SELECT d.*, b.* EXCLUDE (source), coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
 c AS (SELECT *, least(size, greatest(0, floor(target)::BIGINT - epochs * source_size - before))::BIGINT AS cut FROM o)
 SELECT doc_id, source, size, source_size, target, (epochs * size + cut)::BIGINT AS taken, epochs, cut FROM c"""

_ASSIGN = """a{i} AS MATERIALIZED (SELECT x.vec_id, x.part, arg_min(e.entry, (list_sum(list_transform(list_zip(x.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e.entry)) AS entry,
  min(list_sum(list_transform(list_zip(x.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT) AS distance FROM parts x JOIN book{i} e USING (part) GROUP BY 1, 2)"""
_UPDATE = """s{i} AS (SELECT part, entry, place, sum(x)::BIGINT AS total, count(*) AS n FROM (SELECT a.part, a.entry, unnest(p.x) AS x, unnest(range(len(p.x))) AS place FROM a{i} a JOIN parts p USING (vec_id, part)) GROUP BY 1, 2, 3),
 u{i} AS (SELECT part, entry, list((total - ((total % n) + n) % n) // n ORDER BY place) AS x FROM s{i} GROUP BY 1, 2),
 book{j} AS MATERIALIZED (SELECT part, entry, coalesce(u{i}.x, b.x) AS x FROM book{i} b LEFT JOIN u{i} USING (part, entry))"""
_OP11 = f"""WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 parts AS MATERIALIZED (SELECT vec_id, part, list_slice(v, (part * len(v)) // 16 + 1, ((part + 1) * len(v)) // 16) AS x FROM k, range(16) r(part)),
 book0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM parts QUALIFY entry < 64),
 {_ASSIGN.format(i=0)}, {_UPDATE.format(i=0, j=1)}, {_ASSIGN.format(i=1)}, {_UPDATE.format(i=1, j=2)}, {_ASSIGN.format(i=2)},
 coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error FROM a2 GROUP BY 1),
 books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2)
 SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN k USING (vec_id), books"""

_H = "('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), {i}, 8))::BIGINT"
_OP12 = rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
  {_H.format(i=1)} AS h1, {_H.format(i=9)} AS h2, {_H.format(i=17)} AS h3, {_H.format(i=25)} AS h4 FROM documents),
 c AS (SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
 p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""

#: The others are hashes, fitted models and file formats; tests hold them against brute-force versions.
ORACLE_SQL: dict[str, str] = {"op1_embedding_near_dedup": _OP1, "op2_warc": _OP2, "op5_mixing": _OP5, "op11_vector_codes": _OP11, "op12_fill_in_middle": _OP12}
