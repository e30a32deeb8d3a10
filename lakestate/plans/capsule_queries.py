"""Further queries over capsules: corpus, related entities, configuration, envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestate.functions import values as vl
from lakestate.operators import capsule as cp
from lakestate.operators import graph as gr
from lakestate.operators import identity as idn
from lakestate.operators import resolve as rs
from lakestate.operators import retrieve as rt
from lakestate.operators import temporal as tp
from lakestate.operators import validate as va
from lakestate.plans.feed_queries import AT, _capsule_views, _tables
from lakestate.plans.registry import query
from lakestate.session import pinned
from lakestate.sources.adapters import Lake

VIEWS = _capsule_views()


@query(
    "capsule_corpus",
    """SELECT 'capsule-state:' || entity_id || ':' || property AS record_id, entity_id,
         coalesce(label, replace(property, '.', ' ')) || ': ' || replace(value_json, '"', '') || '.' AS text
       FROM resolved LEFT JOIN property_texts USING (property) WHERE status = 'resolved'
       UNION ALL
       SELECT DISTINCT 'capsule-conflict:' || n.entity_id || ':' || n.property || ':' || sha256(CAST(to_json([n.provider, n.external_id, n.value_json]) AS VARCHAR)), n.entity_id,
         'Unresolved conflict for ' || coalesce(label, replace(n.property, '.', ' ')) || ': ' || n.provider || '=' || replace(n.value_json, '"', '') || '.'
       FROM newest n JOIN resolved r USING (probe_id, entity_id, property) LEFT JOIN property_texts l ON l.property = n.property
       WHERE r.status = 'conflict'
       UNION ALL
       SELECT 'graph-relation:' || relation_id, from_id, f.name || ' ' || coalesce(words, relation_type) || ' ' || t.name || '.'
       FROM live JOIN first_names f ON f.entity_id = from_id JOIN first_names t ON t.entity_id = to_id LEFT JOIN relation_texts USING (relation_type)""",
    {**VIEWS, "first_names": "SELECT entity_id, arg_min(value, alias_id) AS name FROM aliases GROUP BY 1"},
)
def capsule_corpus(lake: Lake) -> DataFrame:
    """Everything all capsules say, as records to rank."""
    probe = [tp.Probe("at", AT, AT)]
    cands = pinned(rs.candidates_from_active(tp.active(lake.observations(), lake.retractions(), probe)))
    resolved = pinned(rs.resolve(cands, lake.authority_rules(), rs.KEYS))
    states = rt.state_records(rs.canonical(resolved), rs.conflict_candidates(resolved, cands), "capsule", lake.property_descriptors())
    edges = tp.active_edges(lake.relations(), lake.relation_retractions(), probe)
    told = gr.relation_texts(edges, idn.hydrate(lake.entities(), lake.aliases()), lake.relation_types())
    links = gr.relation_records(told.withColumnRenamed("probe_id", "query_id"))
    return states.select("record_id", "entity_id", "text").unionByName(links.select("record_id", "entity_id", "text"))


@query(
    "capsule_material",
    """SELECT entity_id, 'state' AS section, CAST(to_json([property, value_json, provider, external_id]) AS VARCHAR) AS text FROM resolved WHERE status = 'resolved'
       UNION ALL
       SELECT n.entity_id, 'conflict', CAST(to_json([n.property, CASE WHEN r.rank = 0 THEN 'ambiguous-freshest' ELSE 'ambiguous-authority' END, n.observation_id, n.value_json]) AS VARCHAR)
       FROM newest n JOIN resolved r USING (probe_id, entity_id, property) WHERE r.status = 'conflict'
       UNION ALL
       SELECT from_id, 'relation', CAST(to_json([relation_type, to_id, relation_id]) AS VARCHAR) FROM live
       UNION ALL
       SELECT DISTINCT entity_id, 'retraction', CAST(to_json([retraction_id]) AS VARCHAR) FROM applied""",
    VIEWS,
)
def capsule_material(lake: Lake) -> DataFrame:
    """Every row that capsules are made of, but for the entities themselves."""
    return cp.materialize(_tables(lake), AT)[0].filter("section <> 'entity'").select("entity_id", "section", "text")


@query("capsule_related", "SELECT DISTINCT from_id AS entity_id, to_id AS related_id FROM live", VIEWS)
def capsule_related(lake: Lake) -> DataFrame:
    return cp.related(cp.materialize(_tables(lake), AT)[0])


@query(
    "configuration_version",
    """SELECT sha256(string_agg(d, '' ORDER BY s)) AS version FROM (
         SELECT left(h, 4) AS s, sha256(string_agg(h, '' ORDER BY h)) AS d FROM (
           SELECT sha256('{"entity_id":"' || entity_id || '","property":"' || property || '","kind":"provider","providers":["'
             || string_agg(provider, '","' ORDER BY rank) || '"]}') AS h FROM authority_rules GROUP BY entity_id, property) GROUP BY 1)""",
)
def configuration_version(lake: Lake) -> DataFrame:
    return cp.configuration_version(lake.authority_rules())


@query("capsule_violations", "SELECT entity_id AS id, 'version' AS rule FROM entities WHERE entity_type = 'Nation'")
def capsule_violations(lake: Lake) -> DataFrame:
    """Capsule heads whose version was lost for nations."""
    heads = cp.materialize(_tables(lake), AT)[1].withColumn(
        "configuration_version", F.when(~F.col("entity_id").startswith("entity://nation/"), F.col("configuration_version"))
    )
    return va.violations("capsule", heads, "entity_id")


@query(
    "value_equality",
    """SELECT event_id, json_extract_string(props, '$.k') AS shown, true AS same FROM events""",
)
def value_equality(lake: Lake) -> DataFrame:
    """Values equal whatever their spelling, shown without quotes."""
    k = F.get_json_object("props", "$.k")
    return lake.table("events").select(
        "event_id", vl.context_value(F.concat(F.lit('"'), k, F.lit('"'))).alias("shown"),
        vl.same_value(F.col("props"), F.concat(F.lit('{ "k" : '), k, F.lit(".0 }"))).alias("same"),
    )
