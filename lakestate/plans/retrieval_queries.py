"""Queries over names, edges, rankings and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestate.functions import text as tx
from lakestate.operators import evaluate as ev
from lakestate.operators import graph as gr
from lakestate.operators import identity as idn
from lakestate.operators import resolve as rs
from lakestate.operators import retrieve as rt
from lakestate.operators import temporal as tp
from lakestate.plans.registry import query
from lakestate.plans.state_queries import STATE
from lakestate.session import pinned
from lakestate.sources.adapters import Lake

# -- identity --------------------------------------------------------------

IDENTITY = {
    "matches": """
        SELECT DISTINCT q.query_id, a.entity_id, a.norm, a.value, a.score FROM norm_queries q JOIN scored_aliases a
          ON contains(' ' || q.norm || ' ', ' ' || a.norm || ' ')""",
    "cue_hits": """
        SELECT q.query_id, t.entity_type, max(len(string_split(t.cue, ' ')) * 100 + length(t.cue)) AS cue_score,
          string_agg(t.cue, ',' ORDER BY t.cue) AS cues
        FROM norm_queries q JOIN type_cues t ON contains(' ' || q.norm || ' ', ' ' || t.cue || ' ') GROUP BY 1, 2""",
    "scored": """
        SELECT m.query_id, m.entity_id, any_value(e.entity_type) AS entity_type, max(m.score) AS alias_score,
          max(m.score) + coalesce(10000 + max(c.cue_score), 0) AS score,
          string_agg(DISTINCT m.value, ',' ORDER BY m.value) AS matched, max(c.cues) AS cues
        FROM matches m JOIN entities e USING (entity_id)
        LEFT JOIN cue_hits c ON c.query_id = m.query_id AND c.entity_type = e.entity_type GROUP BY 1, 2""",
    "tops": "SELECT *, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS r FROM scored",
    "resolution": """
        SELECT q.query_id, CASE count(t.entity_id) WHEN 0 THEN 'none' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
          CASE WHEN count(t.entity_id) = 1 THEN min(t.entity_id) END AS entity_id, count(t.entity_id) AS tied
        FROM identity_queries q LEFT JOIN tops t ON t.query_id = q.query_id AND t.r = 1 GROUP BY 1""",
}


def _index(lake: Lake) -> DataFrame:
    return idn.alias_index(lake.aliases())


def _resolution(lake: Lake) -> DataFrame:
    return idn.resolve_entities(lake.identity_queries(), _index(lake), lake.entities(), lake.entity_types())


@query("alias_index", "SELECT DISTINCT entity_id, norm, len(string_split(norm, ' ')) AS tokens, score FROM scored_aliases")
def alias_index(lake: Lake) -> DataFrame:
    return _index(lake).select("entity_id", "norm", "tokens", "score")


@query(
    "alias_lookup",
    """SELECT DISTINCT p.p_brand || ' / ' || p.p_name AS value, a.entity_id, e.entity_type FROM part p JOIN scored_aliases a
         ON a.norm = trim(regexp_replace(lower(p.p_brand || ' / ' || p.p_name), '[^\\p{L}\\p{N}]+', ' ', 'g'))
       JOIN entities e USING (entity_id)""",
)
def alias_lookup(lake: Lake) -> DataFrame:
    asked = lake.table("part").select(F.concat_ws(" / ", "p_brand", "p_name").alias("value"))
    return idn.lookup_alias(asked, _index(lake), lake.entities()).select("value", "entity_id", "entity_type")


@query("alias_phrase_match", "SELECT query_id, entity_id, norm, score FROM matches", IDENTITY)
def alias_phrase_match(lake: Lake) -> DataFrame:
    return idn.match_aliases(lake.identity_queries(), _index(lake)).select("query_id", "entity_id", "norm", "score")


@query(
    "query_ngrams",
    """SELECT DISTINCT query_id, array_to_string(list_slice(t, i, i + n - 1), ' ') AS norm FROM (
         SELECT query_id, t, n, unnest(range(1, len(t) - n + 2)) AS i
         FROM (SELECT query_id, string_split(norm, ' ') AS t FROM norm_queries),
              (SELECT DISTINCT len(string_split(norm, ' ')) AS n FROM scored_aliases))""",
)
def query_ngrams(lake: Lake) -> DataFrame:
    return idn.query_ngrams(lake.identity_queries(), _index(lake))


@query("entity_candidates", "SELECT query_id, entity_id, alias_score, score, matched, cues FROM scored", IDENTITY)
def entity_candidates(lake: Lake) -> DataFrame:
    rows = idn.score_candidates(lake.identity_queries(), _index(lake), lake.entities(), lake.entity_types())
    return rows.select(
        "query_id", "entity_id", "alias_score", "score",
        F.array_join("matched", ",").alias("matched"), F.array_join("cues", ",").alias("cues"),
    )


@query(
    "match_evidence",
    "SELECT DISTINCT query_id, entity_id, 'name:' || entity_id AS ref FROM scored",
    IDENTITY,
)
def match_evidence(lake: Lake) -> DataFrame:
    rows = idn.score_candidates(lake.identity_queries(), _index(lake), lake.entities(), lake.entity_types())
    return idn.match_evidence(rows, lake.aliases())


@query("entity_resolution", "SELECT query_id, status, entity_id, tied FROM resolution", IDENTITY)
def entity_resolution(lake: Lake) -> DataFrame:
    return _resolution(lake).select("query_id", "status", "entity_id", F.coalesce("tied", F.lit(0)).alias("tied"))


@query("entity_resolution_untyped", "SELECT DISTINCT query_id, entity_id FROM matches", IDENTITY)
def entity_resolution_untyped(lake: Lake) -> DataFrame:
    return idn.untyped(lake.identity_queries(), _index(lake))


@query(
    "capsule_search",
    """SELECT query_id, entity_id, score, rank FROM (
         SELECT query_id, entity_id, max(score) AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, entity_id) AS rank
         FROM matches GROUP BY 1, 2) WHERE rank <= 5""",
    IDENTITY,
)
def capsule_search(lake: Lake) -> DataFrame:
    return idn.search(lake.identity_queries(), _index(lake), 5).select("query_id", "entity_id", "score", "rank")


@query(
    "entity_names",
    """SELECT e.entity_id, e.entity_type, coalesce(arg_min(a.value, a.alias_id), e.entity_id) AS name, count(a.value) AS n_aliases
       FROM entities e LEFT JOIN aliases a ON a.entity_id = e.entity_id AND a.recorded_at <= 915148800000 GROUP BY 1, 2""",
)
def entity_names(lake: Lake) -> DataFrame:
    return idn.hydrate(lake.entities(), lake.aliases(), F.lit("1999-01-01").cast("timestamp"))


@query(
    "ambiguous_names",
    "SELECT norm, count(DISTINCT entity_id) AS n_entities FROM scored_aliases GROUP BY 1 HAVING count(DISTINCT entity_id) > 1",
)
def ambiguous_names(lake: Lake) -> DataFrame:
    return idn.ambiguous_names(_index(lake))


@query(
    "indexed_search_agrees",
    "SELECT CAST(0 AS BIGINT) AS n_differences, count(*) AS n_pairs FROM (SELECT DISTINCT query_id, entity_id FROM matches)",
    IDENTITY,
)
def indexed_search_agrees(lake: Lake) -> DataFrame:
    """The n-gram join against a full check of each found and lost pair.

    The scan side re-tests containment on a superset of all matches (``idn.scan_pairs``), so the
    comparison is complete without a cross join.
    """
    index, queries = _index(lake), lake.identity_queries()
    found = pinned(idn.untyped(queries, index))
    scanned = idn.scanned(queries, index)
    n_bad = ev.search_disagreements(found, scanned).agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return found.agg(F.count(F.lit(1)).alias("n_pairs")).select(n_bad.alias("n_differences"), "n_pairs")


# -- rankings ---------------------------------------------------------------

BM25 = {
    "docs": """
        SELECT record_id, r.entity_id, CAST(ceil(length(text) / 4.0) AS INTEGER) + 8 AS cost,
          list_filter(string_split(trim(regexp_replace(lower(concat_ws(' ', coalesce(n.value, ''), text)), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '),
            lambda t: length(t) >= 2) AS terms
        FROM context_records r LEFT JOIN context_names n ON n.entity_id = r.entity_id""",
    "asked": """
        SELECT DISTINCT query_id, unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '),
          lambda t: length(t) >= 2)) AS term FROM the_queries""",
    "tfs": "SELECT record_id, term, count(*) AS tf FROM (SELECT record_id, unnest(terms) AS term FROM docs) GROUP BY 1, 2",
    "cands": "SELECT q.query_id, d.record_id FROM the_queries q, docs d",
    "stats": """
        SELECT c.query_id, count(*) AS n, avg(len(d.terms)) AS avgdl FROM cands c JOIN docs d USING (record_id) GROUP BY 1""",
    "dfs": """
        SELECT a.query_id, a.term, count(*) AS df FROM asked a JOIN tfs t USING (term)
        JOIN cands c ON c.query_id = a.query_id AND c.record_id = t.record_id GROUP BY 1, 2""",
    "ranking": """
        SELECT query_id, record_id, cost, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rn FROM (
          SELECT a.query_id, d.record_id, d.cost,
            round(sum(ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * (t.tf * 2.2)
              / (t.tf + 1.2 * (0.25 + 0.75 * len(d.terms) / s.avgdl))), 6) AS score
          FROM asked a JOIN tfs t USING (term) JOIN docs d ON d.record_id = t.record_id
          JOIN cands c ON c.query_id = a.query_id AND c.record_id = d.record_id
          JOIN stats s ON s.query_id = a.query_id JOIN dfs f ON f.query_id = a.query_id AND f.term = a.term
          GROUP BY 1, 2, 3) WHERE score > 0""",
    "walk": """RECURSIVE
        SELECT query_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS used, false AS taken, CAST(NULL AS VARCHAR) AS record_id, 0 AS cost, budget
        FROM the_queries
        UNION ALL
        SELECT w.query_id, r.rn, CASE WHEN w.used + r.cost <= w.budget THEN w.used + r.cost ELSE w.used END,
          w.used + r.cost <= w.budget, r.record_id, r.cost, w.budget
        FROM walk w JOIN ranking r ON r.query_id = w.query_id AND r.rn = w.rn + 1""",
}
TEXT = {**BM25, "the_queries": "SELECT query_id, text, budget FROM text_queries"}
NAMED = {
    **BM25,
    "the_queries": "SELECT query_id, text, budget FROM source_queries UNION ALL SELECT query_id, text, budget FROM text_queries",
    "hits": """
        SELECT DISTINCT q.query_id, n.entity_id FROM the_queries q JOIN context_names n
          ON contains(' ' || trim(regexp_replace(lower(q.text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ', ' ' || lower(n.value) || ' ')""",
    "cands": """
        SELECT h.query_id, d.record_id FROM hits h JOIN docs d USING (entity_id)
        UNION ALL SELECT q.query_id, d.record_id FROM the_queries q, docs d WHERE q.query_id NOT IN (SELECT query_id FROM hits)""",
}
PICKS = "SELECT query_id, record_id, cost, used AS upto FROM walk WHERE taken"


def _docs(lake: Lake) -> DataFrame:
    return rt.searchable(lake.context_records(), lake.context_entities())


def _all_queries(lake: Lake) -> DataFrame:
    return lake.source_queries().unionByName(lake.text_queries())


def _picked(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    return rt.fill_budget(ranked, queries).select("query_id", "record_id", "cost", F.col("upto").cast("bigint").alias("upto"))


def _named_index(lake: Lake) -> DataFrame:
    return idn.alias_index(lake.context_entities().withColumn("recorded_at", F.lit("1990-01-01").cast("timestamp")))


@query(
    "lexical_ranking",
    """SELECT a.query_id, t.record_id, CAST(count(*) AS DOUBLE) AS score FROM asked a JOIN tfs t USING (term) GROUP BY 1, 2""",
    TEXT,
)
def lexical_ranking(lake: Lake) -> DataFrame:
    return rt.lexical(lake.text_queries(), _docs(lake)).select("query_id", "record_id", "score")


@query("bm25_ranking", "SELECT query_id, record_id, score FROM ranking", TEXT)
def bm25_ranking(lake: Lake) -> DataFrame:
    return rt.bm25(lake.text_queries(), _docs(lake)).select("query_id", "record_id", "score")


@query("bm25_budget", PICKS, TEXT)
def bm25_budget(lake: Lake) -> DataFrame:
    """Flagship retrieval: BM25 and the greedy token budget for many queries."""
    return _picked(rt.bm25(lake.text_queries(), _docs(lake)), lake.text_queries())


@query(
    "lexical_budget",
    PICKS,
    {**TEXT, "ranking": """
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rn FROM (
          SELECT a.query_id, t.record_id, d.cost, count(*) AS score FROM asked a JOIN tfs t USING (term) JOIN docs d USING (record_id) GROUP BY 1, 2, 3)"""},
)
def lexical_budget(lake: Lake) -> DataFrame:
    return _picked(rt.lexical(lake.text_queries(), _docs(lake)), lake.text_queries())


@query("bm25_named_entities", "SELECT query_id, record_id, score FROM ranking", NAMED)
def bm25_named_entities(lake: Lake) -> DataFrame:
    return rt.bm25_filtered(_all_queries(lake), _docs(lake), _named_index(lake)).select("query_id", "record_id", "score")


@query(
    "bm25_state_aware",
    "SELECT query_id, record_id, score FROM ranking",
    {**NAMED, "cands": """
        SELECT q.query_id, d.record_id FROM the_queries q, docs d JOIN context_records r ON r.record_id = d.record_id
        WHERE (NOT regexp_matches(q.text, '(?i)\\bcurrent(ly)?\\b') OR r.is_current)
          AND (q.query_id NOT IN (SELECT query_id FROM hits) OR (q.query_id, d.entity_id) IN (SELECT (query_id, entity_id) FROM hits))""",
     "the_queries": "SELECT query_id, text, budget FROM source_queries"},
)
def bm25_state_aware(lake: Lake) -> DataFrame:
    """Queries with a ``current`` cue see current records of the named entities only."""
    queries = lake.source_queries()
    named = idn.untyped(queries, _named_index(lake))
    records = lake.context_records()
    cued = queries.filter(rt.current_cue(F.col("text"))).select("query_id")
    now = records.filter("current").select("entity_id", "record_id").join(named, "entity_id").join(cued, "query_id", "left_semi")
    rest = records.select("entity_id", "record_id").join(named, "entity_id").join(cued, "query_id", "left_anti")
    cands = now.unionByName(rest).select("query_id", "record_id")
    return rt.bm25_among(queries, _docs(lake), cands).select("query_id", "record_id", "score")


PRIOR = {
    **NAMED,
    "priors": "SELECT * FROM (VALUES ('state', 18), ('decision', 16), ('commitment', 14), ('relationship', 10), ('event', 6), ('artifact', 4)) t(kind, prior)",
    "own_terms": """
        SELECT DISTINCT record_id, unnest(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')) AS term FROM context_records""",
    "term_overlaps": """
        SELECT a.query_id, o.record_id, count(*) AS n FROM asked a JOIN own_terms o USING (term) GROUP BY 1, 2""",
    "ranking": """
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rn FROM (
          SELECT c.query_id, c.record_id, CAST(ceil(length(r.text) / 4.0) AS INTEGER) + 8 AS cost,
            CASE WHEN h.entity_id IS NULL THEN 0 ELSE 30 END + 8 * coalesce(o.n, 0) + CASE WHEN is_current THEN 8 ELSE 0 END
              + floor(coalesce(importance, 0.5) * 10 + 0.5) + prior AS score
          FROM cands c JOIN context_records r USING (record_id) JOIN priors p ON p.kind = r.kind
          LEFT JOIN term_overlaps o ON o.query_id = c.query_id AND o.record_id = c.record_id
          LEFT JOIN hits h ON h.query_id = c.query_id AND h.entity_id = r.entity_id)""",
}


@query("prior_ranking_budget", PICKS, PRIOR)
def prior_ranking_budget(lake: Lake) -> DataFrame:
    queries = _all_queries(lake)
    return _picked(rt.prior_rank(queries, lake.context_records(), _named_index(lake)), queries)


@query(
    "corpus_cost",
    "SELECT count(*) AS n_records, CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT) + 8) AS BIGINT) AS tokens FROM context_records",
)
def corpus_cost(lake: Lake) -> DataFrame:
    return rt.corpus_cost(lake.context_records())


@query(
    "rank_fusion",
    """SELECT query_id, record_id, round(sum(1.0 / (60 + rn)), 6) AS score FROM (
         SELECT query_id, record_id, rn FROM ranking
         UNION ALL SELECT query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) FROM (
           SELECT a.query_id, t.record_id, count(*) AS score FROM asked a JOIN tfs t USING (term) GROUP BY 1, 2))
       GROUP BY 1, 2""",
    TEXT,
)
def rank_fusion(lake: Lake) -> DataFrame:
    return rt.fuse_lexical(lake.text_queries(), _docs(lake))


# -- state as text, as-of retrieval, evaluation --------------------------------

PROBE = tp.Probe("now", "2000-06-30 23:59:59", "2000-06-30 23:59:59")
CUSTOMER_QUERIES = """
    SELECT 'c-' || c_custkey AS query_id, 'What was the order status of ' || c_name || ' on 2000-06-30?' AS text,
      200 AS budget, 'entity://customer/' || c_custkey AS entity_id FROM customer WHERE c_acctbal < 0"""


def _customer_queries(lake: Lake) -> DataFrame:
    return lake.table("customer").filter("c_acctbal < 0").select(
        F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("query_id"),
        F.concat(F.lit("What was the order status of "), F.col("c_name"), F.lit(" on 2000-06-30?")).alias("text"),
        F.lit(200).alias("budget_tokens"),
    )


def _observation_records(lake: Lake) -> DataFrame:
    """Observations of customers as plain texts."""
    return lake.order_observations().select(
        F.col("observation_id").alias("record_id"), "entity_id", "property", "value_json", "recorded_at",
        F.concat(
            tx.readable_property(F.col("property")), F.lit(": "), F.replace("value_json", F.lit('"'), F.lit("")),
            F.lit(" from "), F.col("provider"), F.lit("."),
        ).alias("text"),
    )


def _customer_names(lake: Lake) -> DataFrame:
    return lake.table("customer").select(
        F.concat(F.lit("entity://customer/"), F.col("c_custkey").cast("string")).alias("entity_id"),
        F.col("c_name").alias("value"), F.lit("1990-01-01").cast("timestamp").alias("recorded_at"),
    )


ASOF = {
    **BM25,
    "the_queries": CUSTOMER_QUERIES,
    "obs_records": """
        SELECT observation_id AS record_id, entity_id, property, value_json, recorded_at,
          (CASE property WHEN 'Customer.lastOrderStatus' THEN 'Customer last Order Status' ELSE 'Customer spend Band' END)
            || ': ' || replace(value_json, '"', '') || ' from ' || provider || '.' AS text
        FROM observations WHERE entity_id LIKE 'entity://customer/%'""",
    "docs": """
        SELECT record_id, o.entity_id, CAST(ceil(length(text) / 4.0) AS INTEGER) + 8 AS cost, recorded_at,
          list_filter(string_split(trim(regexp_replace(lower(c_name || ' ' || text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '),
            lambda t: length(t) >= 2) AS terms
        FROM obs_records o JOIN customer c ON o.entity_id = 'entity://customer/' || c_custkey""",
    "cands": """
        SELECT q.query_id, d.record_id FROM the_queries q JOIN docs d USING (entity_id) WHERE d.recorded_at <= 962409599000""",
}


def _as_of_ranking(lake: Lake) -> DataFrame:
    records, queries, names = _observation_records(lake), _customer_queries(lake), _customer_names(lake)
    docs = rt.searchable(records, names)
    dated = queries.select("query_id", tp.query_cutoff(F.col("text")).alias("cutoff"))
    named = idn.untyped(queries, idn.alias_index(names)).join(dated, "query_id")
    seen = records.select("entity_id", "record_id", "recorded_at").join(named, "entity_id").filter(
        F.col("cutoff").isNull() | (F.col("recorded_at") <= F.col("cutoff"))
    )
    return rt.bm25_among(queries, docs, seen.select("query_id", "record_id"))


@query("bm25_as_of", "SELECT query_id, record_id, score FROM ranking", ASOF)
def bm25_as_of(lake: Lake) -> DataFrame:
    """Queries name a day; only what was recorded by its end is ranked."""
    return _as_of_ranking(lake).select("query_id", "record_id", "score")


COMPILED = {
    **{k: v for k, v in STATE.items() if k != "probes"},
    "probes": "SELECT 'now' AS probe_id, 962409599000 AS valid_at, 962409599000 AS known_at",
    "labels_of": """
        SELECT * FROM (VALUES ('Customer.lastOrderStatus', 'Customer last Order Status'), ('Customer.spendBand', 'Customer spend Band'),
          ('User.click', 'User click'), ('User.view', 'User view'), ('User.error', 'User error'), ('User.signup', 'User signup'),
          ('User.purchase', 'User purchase')) t(property, label)""",
    "state_texts": """
        SELECT 'temporal-state:' || entity_id || ':' || property AS record_id, entity_id, property,
          label || ': ' || replace(value_json, '"', '') || '. source=' || provider
            || '. validAt=2000-06-30T23:59:59.000Z. knownAt=2000-06-30T23:59:59.000Z.' AS text
        FROM resolved JOIN labels_of USING (property) WHERE status = 'resolved'
        UNION ALL
        SELECT DISTINCT 'temporal-conflict:' || n.entity_id || ':' || n.property || ':' || sha256(CAST(to_json([n.provider, n.external_id, n.value_json]) AS VARCHAR)), n.entity_id, n.property,
          'Unresolved conflict for ' || label || ': ' || n.provider || '=' || replace(n.value_json, '"', '') || '. Do not assert a single value.'
        FROM newest n JOIN resolved r USING (probe_id, entity_id, property) JOIN labels_of l ON l.property = n.property
        WHERE r.status = 'conflict'""",
}


def _state(lake: Lake) -> tuple[DataFrame, DataFrame]:
    """Candidates and resolution at the probe, each written once."""
    cands = pinned(rs.candidates_from_active(tp.active(lake.observations(), lake.retractions(), [PROBE])))
    return cands, pinned(rs.resolve(cands, lake.authority_rules(), rs.KEYS))


def _state_texts(cands: DataFrame, resolved: DataFrame) -> DataFrame:
    at = F.lit(PROBE.valid_at).cast("timestamp")
    state = rs.canonical(resolved).withColumn("valid_at", at).withColumn("known_at", at)
    return rt.state_records(state, rs.conflict_candidates(resolved, cands), "temporal")


@query("state_as_text", "SELECT record_id, entity_id, text FROM state_texts", COMPILED)
def state_as_text(lake: Lake) -> DataFrame:
    return _state_texts(*_state(lake)).select("record_id", "entity_id", "text")


@query(
    "temporal_compile",
    PICKS,
    {
        **COMPILED,
        "the_queries": CUSTOMER_QUERIES,
        "walk": BM25["walk"],
        "asked": BM25["asked"],
        "own_terms": """
            SELECT DISTINCT record_id, unnest(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')) AS term FROM state_texts""",
        "term_overlaps": "SELECT a.query_id, o.record_id, count(*) AS n FROM asked a JOIN own_terms o USING (term) GROUP BY 1, 2",
        "ranking": """
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rn FROM (
              SELECT q.query_id, s.record_id, CAST(ceil(length(s.text) / 4.0) AS INTEGER) + 8 AS cost,
                30 + 8 * coalesce(o.n, 0) + 10 + 18 AS score
              FROM the_queries q JOIN state_texts s USING (entity_id)
              LEFT JOIN term_overlaps o ON o.query_id = q.query_id AND o.record_id = s.record_id)""",
    },
)
def temporal_compile(lake: Lake) -> DataFrame:
    """Named entities, their state as of a day, prior ranking, budget."""
    queries = _customer_queries(lake)
    index = idn.alias_index(_customer_names(lake))
    records = _state_texts(*_state(lake)).select(
        "record_id", "entity_id", "text", F.lit("state").alias("kind"), F.lit(False).alias("current"), F.lit(1.0).alias("importance")
    )
    named = queries.join(idn.untyped(queries, index), "query_id", "left_semi")
    return _picked(rt.prior_rank(named, records, index), named)


EVAL = {
    **ASOF,
    **{k: v for k, v in COMPILED.items()},
    "expected": """
        SELECT 'c-' || c_custkey AS query_id, r.entity_id, r.property, r.value_json
        FROM customer JOIN resolved r ON r.entity_id = 'entity://customer/' || c_custkey
        WHERE c_acctbal < 0 AND r.status = 'resolved'""",
    "returned": """
        SELECT 'raw' AS method, query_id, record_id, cost FROM walk WHERE taken
        UNION ALL SELECT 'state', q.query_id, s.record_id, CAST(ceil(length(s.text) / 4.0) AS INTEGER) + 8
        FROM the_queries q JOIN state_texts s USING (entity_id) WHERE s.record_id LIKE 'temporal-state:%'""",
    "facts": """
        SELECT record_id, entity_id, property, value_json FROM obs_records
        UNION ALL SELECT 'temporal-state:' || entity_id || ':' || property, entity_id, property, value_json FROM resolved WHERE status = 'resolved'""",
    "told": """
        SELECT e.query_id, r.method, r.record_id, e.entity_id, e.property, f.value_json = e.value_json AS good
        FROM expected e JOIN returned r USING (query_id) JOIN facts f ON f.record_id = r.record_id AND f.entity_id = e.entity_id AND f.property = e.property""",
    "per_query": """
        SELECT m.method, e.query_id, e.wanted,
          (SELECT count(*) FROM returned r WHERE r.method = m.method AND r.query_id = e.query_id) AS n_records,
          (SELECT coalesce(sum(cost), 0) FROM returned r WHERE r.method = m.method AND r.query_id = e.query_id) AS tokens,
          (SELECT count(DISTINCT property) FROM told t WHERE t.method = m.method AND t.query_id = e.query_id AND good) AS hits,
          (SELECT count(*) FROM told t WHERE t.method = m.method AND t.query_id = e.query_id AND NOT good) AS wrong,
          (SELECT count(DISTINCT record_id) FROM told t WHERE t.method = m.method AND t.query_id = e.query_id AND good) AS relevant
        FROM (SELECT query_id, count(*) AS wanted FROM expected GROUP BY 1) e, (SELECT DISTINCT method FROM returned) m""",
}


@query(
    "retrieval_evaluation",
    """SELECT method, count(*) AS n_queries, round(avg(CASE WHEN hits = wanted AND wrong = 0 THEN 1 ELSE 0 END), 4) AS success,
         round(avg(round(hits / wanted, 3)), 4) AS recall,
         round(avg(round(CASE WHEN n_records = 0 THEN 0 ELSE 1 - relevant / n_records END, 3)), 4) AS irrelevant,
         round(avg(tokens), 2) AS tokens, CAST(sum(wrong) AS BIGINT) AS contradictions FROM per_query GROUP BY 1""",
    EVAL,
)
def retrieval_evaluation(lake: Lake) -> DataFrame:
    """Raw as-of BM25 against resolved state: recall, contradictions, tokens."""
    queries, names = _customer_queries(lake), _customer_names(lake)
    cands, resolved = _state(lake)
    state = rs.canonical(resolved)
    named = pinned(idn.untyped(queries, idn.alias_index(names)))
    expected = state.join(named, "entity_id").select("query_id", "entity_id", "property", "value_json")
    raw = rt.fill_budget(_as_of_ranking(lake), queries).select(F.lit("raw").alias("method"), "query_id", "record_id", "cost")
    told = _state_texts(cands, resolved).filter(F.col("record_id").startswith("temporal-state:")).join(named, "entity_id")
    states = told.select(F.lit("state").alias("method"), "query_id", "record_id", tx.record_cost(F.col("text")).alias("cost"))
    facts = _observation_records(lake).select("record_id", "entity_id", "property", "value_json").unionByName(
        state.select(
            F.concat_ws(":", F.lit("temporal-state"), "entity_id", "property").alias("record_id"), "entity_id", "property", "value_json"
        )
    )
    return ev.summarise(ev.evaluate(pinned(raw.unionByName(states)), facts, pinned(expected)))


# -- graph ----------------------------------------------------------------------

GRAPH_PROBE = tp.Probe("g", "1999-06-30 00:00:00", "1999-12-31 00:00:00")
MAX_EDGES = 4
GRAPH = {
    **IDENTITY,
    "probes": "SELECT 'g' AS probe_id, 930700800000 AS valid_at, 946598400000 AS known_at",
    "live": """
        SELECT e.* FROM relations e JOIN probes p ON e.valid_from <= p.valid_at AND (e.valid_to IS NULL OR p.valid_at < e.valid_to) AND e.recorded_at <= p.known_at
        WHERE NOT EXISTS (SELECT 1 FROM relation_retractions r WHERE r.target_id = e.relation_id
          AND r.recorded_at <= p.known_at AND r.effective_from <= p.valid_at)""",
    "names": "SELECT entity_id, arg_min(value, alias_id) AS name FROM aliases GROUP BY 1",
    "texts": """
        SELECT e.*, coalesce(f.name, from_id) || ' ' || coalesce(words, relation_type) || ' ' || coalesce(t.name, to_id) || '.' AS text
        FROM live e LEFT JOIN names f ON f.entity_id = from_id LEFT JOIN names t ON t.entity_id = to_id LEFT JOIN relation_texts USING (relation_type)""",
    "directs": "SELECT query_id, entity_id FROM resolution WHERE status = 'resolved'",
    "edge_cands": """
        SELECT d.query_id, t.relation_id, t.from_id, t.to_id, t.text, CAST(ceil(length(t.text) / 4.0) AS INTEGER) + 8 AS cost,
          len(list_intersect(list_distinct(list_filter(string_split(q.norm, ' '), lambda x: length(x) >= 2)),
            string_split(trim(regexp_replace(lower(t.text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '))) AS overlap
        FROM directs d JOIN norm_queries q USING (query_id) JOIN texts t ON t.from_id = d.entity_id""",
    "edge_rank": """
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, cost, relation_id) AS rn FROM edge_cands WHERE overlap > 0""",
    "edge_walk": f"""RECURSIVE
        SELECT query_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS picks, false AS taken, CAST(NULL AS VARCHAR) AS relation_id, CAST(NULL AS VARCHAR) AS to_id
        FROM directs
        UNION ALL
        SELECT w.query_id, r.rn, CASE WHEN w.used + r.cost <= 90 THEN w.used + r.cost ELSE w.used END,
          CASE WHEN w.used + r.cost <= 90 THEN w.picks + 1 ELSE w.picks END, w.used + r.cost <= 90, r.relation_id, r.to_id
        FROM edge_walk w JOIN edge_rank r ON r.query_id = w.query_id AND r.rn = w.rn + 1 WHERE w.picks < {MAX_EDGES}""",
    "edge_picks": "SELECT query_id, relation_id, to_id FROM edge_walk WHERE taken",
    "reached": "SELECT query_id, entity_id FROM directs UNION SELECT query_id, to_id FROM edge_picks",
}


def _graph_queries(lake: Lake) -> DataFrame:
    return lake.identity_queries().withColumn("budget_tokens", F.lit(90))


def _edge_texts(lake: Lake, direct: DataFrame | None = None) -> DataFrame:
    """Live edges with their texts; with ``direct`` only those that leave one of its entities."""
    frontier = None
    if direct is not None:
        frontier = direct.select(F.lit(GRAPH_PROBE.probe_id).alias("probe_id"), F.col("entity_id").alias("from_id")).distinct()
    edges = tp.active_edges(lake.relations(), lake.relation_retractions(), [GRAPH_PROBE], frontier)
    return gr.relation_texts(edges, idn.hydrate(lake.entities(), lake.aliases()), lake.relation_types())


def _direct(lake: Lake) -> DataFrame:
    found = _resolution(lake).filter("status = 'resolved'").select("query_id", "entity_id")
    return found.join(lake.identity_queries(), "query_id")


def _edge_candidates(lake: Lake) -> DataFrame:
    direct = pinned(_direct(lake))
    return gr.relation_candidates(direct, _edge_texts(lake, direct))


def _hop(lake: Lake) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resolved entities, scored edges and picks. Each is read several times
    below, so each is computed once and written."""
    direct = pinned(_direct(lake))
    edges = pinned(gr.relation_candidates(direct, _edge_texts(lake, direct)))
    return direct, edges, pinned(gr.pick_edges(edges, _graph_queries(lake), MAX_EDGES))


@query("relation_texts", "SELECT relation_id, text FROM texts", GRAPH)
def relation_texts(lake: Lake) -> DataFrame:
    return _edge_texts(lake).select("relation_id", "text")


@query("relation_relevance", "SELECT query_id, relation_id, overlap, cost FROM edge_cands WHERE overlap > 0", GRAPH)
def relation_relevance(lake: Lake) -> DataFrame:
    return _edge_candidates(lake).select("query_id", "relation_id", "overlap", "cost")


@query("edge_selection", "SELECT query_id, relation_id FROM edge_picks", GRAPH)
def edge_selection(lake: Lake) -> DataFrame:
    return gr.pick_edges(_edge_candidates(lake), _graph_queries(lake), MAX_EDGES).select("query_id", "relation_id")


@query("graph_frontier", "SELECT query_id, entity_id FROM reached", GRAPH)
def graph_frontier(lake: Lake) -> DataFrame:
    return gr.frontier(*_hop(lake))


@query(
    "traversal_stats",
    """SELECT c.query_id, count(*) AS candidate_edges,
         (SELECT count(*) FROM edge_picks p WHERE p.query_id = c.query_id) AS traversed_edges
       FROM edge_cands c WHERE overlap > 0 GROUP BY 1""",
    GRAPH,
)
def traversal_stats(lake: Lake) -> DataFrame:
    _, edges, picks = _hop(lake)
    return gr.traversal_stats(edges, picks).select("query_id", "candidate_edges", "traversed_edges")


GRAPH_COMPILE = {
    **GRAPH,
    **{k: v for k, v in STATE.items() if k != "probes"},
    "state_props": "SELECT entity_id, property, status, value_json FROM resolved",
    "graph_records": """
        SELECT p.query_id, 'graph-relation:' || p.relation_id AS record_id, t.from_id AS entity_id, t.text
        FROM edge_picks p JOIN texts t USING (relation_id)
        UNION ALL
        SELECT q.query_id, 'graph-state:' || s.entity_id || ':' || s.property, s.entity_id,
          l.label || ': ' || replace(s.value_json, '"', '') || '.'
        FROM reached q JOIN state_props s USING (entity_id) JOIN property_texts l USING (property) WHERE status = 'resolved'
        UNION ALL
        SELECT DISTINCT q.query_id, 'graph-conflict:' || n.entity_id || ':' || n.property || ':' || sha256(CAST(to_json([n.provider, n.external_id, n.value_json]) AS VARCHAR)), n.entity_id,
          'Unresolved conflict for ' || l.label || ': ' || n.provider || '=' || replace(n.value_json, '"', '') || '.'
        FROM reached q JOIN newest n USING (entity_id) JOIN resolved r ON r.entity_id = n.entity_id AND r.property = n.property
        JOIN property_texts l ON l.property = n.property WHERE r.status = 'conflict'""",
    "owners": """
        SELECT entity_id, array_to_string(list_sort(list(DISTINCT value)), ' ') AS owner FROM aliases GROUP BY 1""",
    "docs": """
        SELECT query_id, record_id, CAST(ceil(length(text) / 4.0) AS INTEGER) + 8 AS cost,
          list_filter(string_split(trim(regexp_replace(lower(concat_ws(' ', coalesce(owner, ''), text)), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '),
            lambda t: length(t) >= 2) AS terms
        FROM graph_records LEFT JOIN owners USING (entity_id)""",
    "the_queries": "SELECT query_id, text, 90 AS budget FROM identity_queries",
    "asked": BM25["asked"],
    "tfs": "SELECT query_id, record_id, term, count(*) AS tf FROM (SELECT query_id, record_id, unnest(terms) AS term FROM docs) GROUP BY 1, 2, 3",
    "stats": "SELECT query_id, count(*) AS n, avg(len(terms)) AS avgdl FROM docs GROUP BY 1",
    "dfs": "SELECT a.query_id, a.term, count(*) AS df FROM asked a JOIN tfs t USING (query_id, term) GROUP BY 1, 2",
    "ranking": """
        SELECT query_id, record_id, cost, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rn FROM (
          SELECT a.query_id, d.record_id, d.cost,
            round(sum(ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * (t.tf * 2.2)
              / (t.tf + 1.2 * (0.25 + 0.75 * len(d.terms) / s.avgdl))), 6) AS score
          FROM asked a JOIN tfs t USING (query_id, term) JOIN docs d ON d.record_id = t.record_id AND d.query_id = t.query_id
          JOIN stats s ON s.query_id = a.query_id JOIN dfs f ON f.query_id = a.query_id AND f.term = a.term
          GROUP BY 1, 2, 3) WHERE score > 0""",
    "walk": BM25["walk"],
}


def _graph_records(lake: Lake) -> DataFrame:
    """Records of each query's frontier: picked edges and the state of reached entities."""
    direct, edges, picks = _hop(lake)
    chosen = edges.join(picks.select("query_id", "relation_id"), ["query_id", "relation_id"], "left_semi")
    reached = gr.frontier(direct, edges, picks)
    # Only entities some query reached are resolved.
    wanted = lake.observations().join(reached.select("entity_id").distinct(), "entity_id", "left_semi")
    cands = pinned(rs.candidates_from_active(tp.active(wanted, lake.retractions(), [GRAPH_PROBE])))
    resolved = pinned(rs.resolve(cands, lake.authority_rules(), rs.KEYS))
    texts = rt.state_records(rs.canonical(resolved), rs.conflict_candidates(resolved, cands), "graph", lake.property_descriptors())
    states = texts.join(reached, "entity_id").select("query_id", "record_id", "entity_id", "text")
    return gr.relation_records(chosen).unionByName(states)


@query("graph_records", "SELECT query_id, record_id, text FROM graph_records", GRAPH_COMPILE)
def graph_records(lake: Lake) -> DataFrame:
    return _graph_records(lake).select("query_id", "record_id", "text")


@query("graph_compile", PICKS, GRAPH_COMPILE)
def graph_compile(lake: Lake) -> DataFrame:
    """Resolve, take one hop, rank state and edges by BM25, fill the budget."""
    records = pinned(_graph_records(lake))
    names = lake.aliases().select("entity_id", "value")
    docs = rt.searchable(records.select("record_id", "entity_id", "text").distinct(), names)
    ranked = rt.bm25_among(lake.identity_queries(), docs, records.select("query_id", "record_id"))
    return _picked(ranked, _graph_queries(lake))


@query(
    "graph_untyped_hop",
    """SELECT query_id, entity_id FROM (SELECT DISTINCT query_id, entity_id FROM matches)
       UNION SELECT m.query_id, r.to_id FROM matches m JOIN relations r ON r.from_id = m.entity_id""",
    IDENTITY,
)
def graph_untyped_hop(lake: Lake) -> DataFrame:
    """Every named entity and all that its relations point to."""
    named = idn.untyped(lake.identity_queries(), _index(lake))
    records = lake.relations().select(F.col("from_id").alias("entity_id"), F.array("to_id").alias("related_entity_ids"))
    return rt.related_candidates(named, records)


@query(
    "degree_profile",
    """SELECT p.probe_id, e.from_id, e.relation_type, count(*) AS n_edges, count(DISTINCT e.to_id) AS n_targets
       FROM relations e JOIN probes p
         ON e.valid_from <= p.valid_at AND (e.valid_to IS NULL OR p.valid_at < e.valid_to) AND e.recorded_at <= p.known_at
       WHERE NOT EXISTS (SELECT 1 FROM relation_retractions r WHERE r.target_id = e.relation_id
         AND r.recorded_at <= p.known_at AND r.effective_from <= p.valid_at) GROUP BY 1, 2, 3""",
    STATE,
)
def degree_profile(lake: Lake) -> DataFrame:
    from lakestate.plans.state_queries import PROBES

    return gr.degree_profile(tp.active_edges(lake.relations(), lake.relation_retractions(), PROBES))
