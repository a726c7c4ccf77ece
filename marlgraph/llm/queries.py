"""Queries p1, p8, p9 and p10 and their SQL."""

from __future__ import annotations

import hashlib
import unicodedata

from pyspark.sql import DataFrame, SparkSession

from marlgraph.llm import leakage, pii, similar, tokenize
from marlgraph.runtime import shared_dir
from marlgraph.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar.near_pairs(table(spark, folder, "entity_embeddings"), k=5, limit=0.40, dim=64)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.encode(table(spark, folder, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), words=12, errors=0)


def p9_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold twelve words of an item with up to three edits of characters."""
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), words=12, errors=3)


def _recogniser(spark: SparkSession, folder: str, documents: DataFrame) -> pii.Recogniser:
    """Fitted once for the tables of a folder, whichever of the two queries comes first."""
    place = hashlib.sha256(folder.encode()).hexdigest()[:16]
    return pii.fit_on(documents, table(spark, folder, "contacts"), keep=f"{shared_dir(spark)}/pii-models/{place}")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return pii.find(documents, _recogniser(spark, folder, documents)).select("doc_id", "pii_type", "pii_text").distinct()


def p10_redacted(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return pii.redact(documents, _recogniser(spark, folder, documents))


QUERIES = {f.__name__: f for f in (p1_found, p8_ids, p9_found, p9_edits, p10_found, p10_redacted)}


def _words_sql(text: str) -> str:
    """A text's words in comparable form. Compatibility forms come from Unicode's rule for the characters of Latin texts, symbols and full width."""
    single, several = {}, {}
    for c in [*range(0xA0, 0x250), *range(0x2000, 0x2190), *range(0x2460, 0x24EB), *range(0x3000, 0x3001), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFFE7)]:
        if (to := unicodedata.normalize("NFKC", chr(c)).casefold()) != chr(c).lower():
            (single if len(to) == 1 else several)[chr(c)] = to.replace("'", " ")
    bare = f"translate(regexp_replace({text}, '\\p{{Cf}}', '', 'g'), '{''.join(single)}', '{''.join(single.values())}')"
    for c, to in several.items():
        bare = f"replace({bare}, '{c}', '{to}')"
    return f"regexp_extract_all(nfc_normalize(lower(nfc_normalize({bare}))), '[\\p{{L}}\\p{{N}}]+')"


def sql() -> dict[str, str]:
    grams = lambda t, k: f"SELECT DISTINCT {k}, array_to_string(w[i:i + 11], ' ') g FROM (SELECT {k}, w, unnest(generate_series(1, len(w) - 11)) i FROM (SELECT {k}, {_words_sql('text')} w FROM {t} WHERE text IS NOT NULL))"
    return {
        "p9_found": f"WITH i AS ({grams('eval_items', 'item_id')}), d AS ({grams('documents', 'doc_id')}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)",
        "p1_found": """WITH v AS (SELECT lower(trim(domain)) d, node_id, min(vector) v FROM entity_embeddings WHERE domain IS NOT NULL AND node_id IS NOT NULL AND len(vector) = 64
  AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY ALL),
p AS (SELECT a.node_id a, b.node_id b, list_distance(a.v::DOUBLE[], b.v::DOUBLE[]) x FROM v a JOIN v b ON a.d = b.d AND a.node_id <> b.node_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY x, b) k FROM p)
SELECT DISTINCT least(a, b) node_id_a, greatest(a, b) node_id_b FROM r WHERE k <= 5 AND x <= 0.40""",
    }
