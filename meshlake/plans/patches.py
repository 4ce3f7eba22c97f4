"""From triangles to linked contact patches: the whole plan, stage by stage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlake.config import DEFAULT, Config
from meshlake.operators import canonical, contact, patch, topology
from meshlake.session import Scratch
from meshlake.sources import store


def patches(triangles: DataFrame, config: Config = DEFAULT, mode: str = "aabb") -> dict[str, DataFrame]:
    """pairs, summary (validated), graph, components, links and objects of a model. The pair table is what everything else
    is made of, so it's written once."""
    scratch = Scratch(triangles.sparkSession, "patches")
    measured = scratch.write(canonical.measured(triangles), "triangles")
    pairs = contact.contacts(triangles, config, mode, measured)
    near = scratch.write(topology.neighbours(canonical.by_points(triangles)), "neighbours")
    summary = scratch.write(patch.validated(patch.summary(pairs, measured), lambda g: patch.threshold(g, config)), "summary")
    accepted = summary.where("final_evaluation").select(*patch.SIDE, "tri_id")
    edges = scratch.write(patch.accepted_graph(accepted, near), "edges")
    parts = scratch.write(patch.patch_components(accepted, edges), "components")
    links = patch.component_links(pairs, parts)
    return {"pairs": pairs, "summary": summary, "graph": patch.area_graph(accepted, pairs, edges, measured), "components": parts, "links": links, "objects": patch.object_graph(links), "first": patch.first_links(links), "triangles": measured, "edges": edges, "accepted": accepted.select("*", F.lit(True).alias("accepted"))}


def kept_patches(triangles: DataFrame, root: str, results: Sequence[str], config: Config = DEFAULT, mode: str = "aabb") -> dict[str, DataFrame]:
    """Some results of patches(), by their names there, for these triangles and parameters: read from under root if they were computed before."""
    return store.kept(triangles, root, results, lambda: patches(triangles, config, mode), mode=mode, **asdict(config))
