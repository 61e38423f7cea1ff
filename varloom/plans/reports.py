"""Composite reports that consist of several tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.operators import compare, cooccurrence, graph, matrix, metrics, ordering, pathway, position, signature, suggest
from varloom.operators import filters as flt
from varloom.operators.filters import BadRequest
from varloom.roles import Roles, col


def oncoplot(cells: DataFrame, genes: Sequence[str]) -> dict[str, DataFrame]:
    """Axes, heat-map cells and bars of a cell table for a gene list."""
    return {
        "genes": matrix.gene_axis(cells, genes),
        "samples": matrix.sample_axis(cells, genes),
        "cells": matrix.heatmap_cells(cells, genes),
        "gene_bar": matrix.gene_annotation_bar(cells, genes),
        "sample_bar": matrix.sample_annotation_bar(cells, genes),
    }


def interaction_heatmap(pairs: DataFrame, genes: Sequence[str]) -> DataFrame:
    return cooccurrence.interaction_heatmap(pairs, genes)


def oncoplot_matrix(
    df: DataFrame,
    genes: Sequence[str],
    filters: Mapping[str, Any] | None = None,
    categories: Sequence[str] = ("all",),
    samples: Sequence[str] | None = None,
    max_samples: int | None = None,
    gene_order: str = "mutation_frequency",
    sample_order: str = "mutation_count",
    custom_genes: Sequence[str] | None = None,
    custom_samples: Sequence[str] | None = None,
    annotation_column: str | None = None,
    roles: Roles = Roles(),
) -> dict[str, DataFrame]:
    """Alteration matrix of a gene list with ordered axes, frequencies over the samples shown, and the variants behind it."""
    rows = flt.apply(df, filters)
    hits = matrix.altered(rows, genes, categories, samples, roles)
    everyone = matrix.samples_with_counts(rows, hits, roles)
    if samples:
        everyone = everyone.filter(F.col("sample").isin(list(samples)))
    shown = matrix.top_samples(everyone, max_samples) if max_samples else everyone
    cells = matrix.alteration_matrix(hits)
    if max_samples:
        cells = cells.join(shown.select("sample"), "sample", "left_semi")
    restricted = shown if samples or max_samples else None
    frequency = matrix.gene_frequency(rows, hits, genes, roles, restricted)
    annotation = matrix.clinical_annotation(rows, annotation_column, roles) if annotation_column else None
    out = {
        "matrix": cells,
        "genes": matrix.ordered_genes(frequency, gene_order, custom_genes),
        "samples": matrix.ordered_samples(shown, sample_order, custom_samples, annotation),
    }
    behind = hits.join(shown.select("sample"), "sample", "left_semi") if max_samples else hits
    out["details"] = matrix.mutation_details(rows, behind, roles)
    if annotation is not None:
        out["annotation"] = shown.select("sample").join(annotation, "sample")
    return out


def autocomplete(
    genelist: DataFrame, pathways: DataFrame, association: DataFrame, term: str, limit: int = 10
) -> dict[str, DataFrame]:
    return {
        "genes": suggest.genes(genelist, term, limit),
        "pathways": suggest.pathways(pathways, association, term, limit),
    }


def _ordered(
    out: DataFrame, order_by: str | None, descending: bool, limit: int | None
) -> DataFrame:
    """The rows in the order of one output column (null as 0, ties by the other columns), at most ``limit`` of them."""
    if order_by is None and limit is None:
        return out
    simple = [c for c, t in out.dtypes if not t.startswith(("map", "struct", "array"))]
    if order_by is not None:
        return ordering.sort_nulls_as_zero(out, order_by, [c for c in simple if c != order_by], descending, limit)
    return ordering.top(out, limit, [col(c).asc() for c in simple])


def position_analysis(
    df: DataFrame, kind: str, roles: Roles = Roles(), order_by: str | None = None, descending: bool = False,
    limit: int | None = None, **options: Any,
) -> DataFrame:
    """hotspots, sliding, gene_based, density, region or codon; optionally sorted and cut."""
    kinds = {
        "hotspots": position.fixed_windows,
        "sliding": position.sliding_windows,
        "gene_based": position.gene_windows,
        "density": position.density,
        "region": position.by_position,
        "codon": position.by_codon,
    }
    return _ordered(_choose(kinds, kind)(df, roles=roles, **options), order_by, descending, limit)


def signature_analysis(
    df: DataFrame, kind: str, roles: Roles = Roles(), order_by: str | None = None, descending: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """profile, nested, samples or titv; optionally sorted and cut."""
    kinds = {
        "profile": signature.profile,
        "nested": lambda d, roles: signature.nested_profile(signature.profile(d, roles)),
        "samples": signature.sample_spectrum,
        "titv": signature.sample_titv,
    }
    return _ordered(_choose(kinds, kind)(df, roles=roles), order_by, descending, limit)


def compare_datasets(
    data: DataFrame, kind: str, labels: Sequence[str] = (), roles: Roles = Roles(), order_by: str | None = None,
    descending: bool = False, limit: int | None = None, **options: Any,
) -> DataFrame:
    """mutation_frequency, variant_overlap, sample_statistics or summary; optionally sorted and cut."""
    kinds = {
        "mutation_frequency": lambda: compare.gene_frequencies(data, labels, roles=roles, **options),
        "variant_overlap": lambda: compare.variant_overlap(data, roles=roles, **options),
        "sample_statistics": lambda: compare.sample_statistics(data, roles),
        "summary": lambda: compare.dataset_summary(data, roles),
    }
    return _ordered(_choose(kinds, kind)(), order_by, descending, limit)


def pathway_analysis(
    kind: str,
    association: DataFrame,
    pathways: DataFrame,
    df: DataFrame | None = None,
    genes: Sequence[str] = (),
    pathway_id: str | None = None,
    name_contains: str | None = None,
    roles: Roles = Roles(),
    order_by: str | None = None,
    descending: bool = False,
    limit: int | None = None,
    **options: Any,
) -> DataFrame:
    """enrichment, pathway_genes or gene_pathways; arguments are checked together.  Optionally sorted and cut."""
    found = _pathway_rows(kind, association, pathways, df, genes, pathway_id, name_contains, roles, options)
    return _ordered(found, order_by, descending, limit)


def _pathway_rows(
    kind: str, association: DataFrame, pathways: DataFrame, df: DataFrame | None, genes: Sequence[str],
    pathway_id: str | None, name_contains: str | None, roles: Roles, options: Mapping[str, Any],
) -> DataFrame:
    if kind == "enrichment":
        if df is None or not genes:
            raise BadRequest("enrichment needs a table and a gene list")
        background = pathway.mutated_genes(df, roles)
        return pathway.enrichment(background, association, pathways, genes, name_contains=name_contains, **options)
    if kind == "pathway_genes":
        if not pathway_id:
            raise BadRequest("pathway_genes needs a pathway id")
        return pathway.genes_of_pathway(association, pathway_id)
    if kind == "gene_pathways":
        if not genes:
            raise BadRequest("gene_pathways needs a gene list")
        return pathway.pathways_of_genes(association, pathways, genes, name_contains)
    raise BadRequest(f"unknown pathway analysis {kind!r}")


def gene_network(
    edges: DataFrame,
    kind: str,
    genes: Sequence[str],
    partners: Sequence[str] = (),
    hops: int = 2,
    limit: int | None = None,
    order_by: str | None = None,
    descending: bool = False,
    **options: Any,
) -> DataFrame:
    """direct_partners, neighbors, shortest_path or common_partners; optionally sorted and cut."""
    if not genes:
        raise BadRequest("a gene list is needed")
    if kind == "direct_partners":
        found = graph.direct_partners(edges, genes, **options)
        if order_by:
            return _ordered(found, order_by, descending, limit)
        return graph.best_partners(found, limit) if limit else found
    if kind == "neighbors":
        out, key = graph.neighbours(edges, genes, hops, **options), ["distance", "gene"]
    elif kind == "shortest_path":
        if not partners:
            raise BadRequest("shortest_path needs partner genes")
        out = graph.shortest_paths(edges, genes, partners, hops, **options)
        key = ["path_length", "source_gene", "target_gene"]
    elif kind == "common_partners":
        out, key = graph.common_partners(edges, genes, **options), ["common_partner"]
    else:
        raise BadRequest(f"unknown network analysis {kind!r}")
    if order_by:
        return _ordered(out, order_by, descending, limit)
    return ordering.top(out, limit, [col(k).asc() for k in key]) if limit else out


def protein_mapping(
    df: DataFrame, kind: str, domains: DataFrame | None = None, genes: Sequence[str] | None = None,
    roles: Roles = Roles(), order_by: str | None = None, descending: bool = False, limit: int | None = None, **options: Any,
) -> DataFrame:
    """domain_mapping, hotspots or domain_enrichment; optionally sorted and cut."""
    rows = flt.genes_in(df, genes, roles) if genes else df
    if kind == "hotspots":
        return _ordered(position.greedy_hotspots(rows, roles=roles, **options), order_by, descending, limit)
    if domains is None:
        raise BadRequest(f"{kind} needs the domain table")
    kinds = {"domain_mapping": position.map_to_domains, "domain_enrichment": position.domain_enrichment}
    return _ordered(_choose(kinds, kind)(rows, domains, roles=roles, **options), order_by, descending, limit)


def sample_metrics(
    table: DataFrame,
    samples: Sequence[str] | None = None,
    tmb_range: tuple[float | None, float | None] = (None, None),
    count_range: tuple[int | None, int | None] = (None, None),
    sort_by: str | None = None,
    descending: bool = False,
    page: int = 1,
    page_size: int = 100,
) -> DataFrame:
    """One page of a stored summary table."""
    chosen = metrics.select_samples(table, samples, tmb_range, count_range)
    key = [c for c in metrics.SAMPLE_COLUMNS if c in table.columns][:1]
    rows = ordering.page(chosen, page, page_size, sort_by, key, descending, max_size=10000)
    return flt.normalise_numbers(rows)


def pairwise_cooccurrence(df: DataFrame, genes: Sequence[str] | None = None, roles: Roles = Roles()) -> DataFrame:
    return cooccurrence.pairwise_fisher(df, genes, roles=roles)


def _choose(kinds: Mapping[str, Any], kind: str):
    if kind not in kinds:
        raise BadRequest(f"unknown kind {kind!r}, expected one of {sorted(kinds)}")
    return kinds[kind]
