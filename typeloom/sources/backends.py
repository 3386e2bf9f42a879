"""The aligners whose outputs are read, and the providers whose catalogues are, each by name; further ones can be registered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from typeloom.sources.text import read_blast, read_catalog, read_coords, read_paf, read_res


@dataclass(frozen=True)
class Backend:
    """A reader of hits (spark, path, loci, sample), and whether the aligner takes reads."""

    name: str
    read: Callable[..., DataFrame]
    takes_reads: bool


BACKENDS = {b.name: b for b in (Backend("blastn", read_blast, False), Backend("kma", read_res, True), Backend("minimap2", read_paf, True), Backend("nucmer", read_coords, False))}
#: Readers of a provider's catalogue (spark, path); the fetching of catalogues is left to others.
PROVIDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = dict.fromkeys(("pubmlst", "pasteur", "enterobase", "cgmlst"), read_catalog)


def register_backend(backend: Backend) -> None:
    BACKENDS[backend.name.lower()] = backend


def register_provider(name: str, read: Callable[[SparkSession, str], DataFrame]) -> None:
    PROVIDERS[name.lower()] = read


def hits_of(spark: SparkSession, backend: str, path: str, loci: DataFrame | None = None, sample: Column | None = None, reads: bool = False) -> DataFrame:
    """The hits in a backend's output files; an unknown backend, or reads for one that takes none, is an error."""
    found = BACKENDS.get(backend.lower())
    if found is None:
        raise ValueError(f"unknown backend {backend!r}; one of {', '.join(BACKENDS)}")
    if reads and not found.takes_reads:
        raise ValueError(f"{backend} takes no reads")
    more = {"reads": reads} if found.read is read_res else {}
    return found.read(spark, path, loci, sample, **more)


def catalog_of(spark: SparkSession, provider: str, path: str) -> DataFrame:
    found = PROVIDERS.get(provider.lower())
    if found is None:
        raise ValueError(f"unknown provider {provider!r}; one of {', '.join(PROVIDERS)}")
    return found(spark, path)
