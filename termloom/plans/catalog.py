"""All queries of the retrieval engine and their SQL."""

from __future__ import annotations

from termloom.plans import entities, fields, joint, ranking, retrieval

QUERIES = {**retrieval.QUERIES, **ranking.QUERIES, **entities.QUERIES, **fields.QUERIES, **joint.QUERIES}
ORACLE_SQL = {**retrieval.ORACLE_SQL, **ranking.ORACLE_SQL, **entities.ORACLE_SQL, **fields.ORACLE_SQL, **joint.ORACLE_SQL}
FLAGSHIP = "bm25_top10"
