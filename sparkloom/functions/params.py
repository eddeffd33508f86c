"""Parameters of the similarity search, from keywords or a command line."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class KnnParams:
    """nnbrs: neighbours kept for a query, -1 for all. minsim: least similarity, inclusive."""

    nnbrs: int = 100
    minsim: float = 0.25
    verbosity: int = 0
    nthreads: int = 1
    infstem: str = ""
    outfile: str | None = None

    def __post_init__(self) -> None:
        if self.nnbrs < 1 and self.nnbrs != -1:
            raise ValueError("nnbrs must be at least 1, or -1 for all")
        if not self.minsim >= 0:
            raise ValueError("minsim must be 0 or more")
        if self.nthreads < 1:
            raise ValueError("nthreads must be at least 1")


def parse(argv: Sequence[str]) -> KnnParams:
    """``[-nnbrs N] [-minsim S] [-verbosity V] [-nthreads T] infstem [outfile]``; unique prefixes will do."""
    p = argparse.ArgumentParser(prog="knn", description="Thresholded top-k similarity of sparse rows.", allow_abbrev=True)
    p.add_argument("-nnbrs", type=int, default=KnnParams.nnbrs, help="neighbours a query, default %(default)s")
    p.add_argument("-minsim", type=float, default=KnnParams.minsim, help="least similarity, default %(default)s")
    p.add_argument("-verbosity", type=int, default=KnnParams.verbosity, help="default %(default)s")
    p.add_argument("-nthreads", type=int, default=KnnParams.nthreads, help="local cores, default %(default)s")
    p.add_argument("infstem", help="sparse matrix file")
    p.add_argument("outfile", nargs="?", default=None, help="neighbour file")
    return KnnParams(**vars(p.parse_intermixed_args(argv)))


def main(argv: Sequence[str] | None = None) -> None:
    """Read a sparse matrix, find the neighbours of every row, write them where an output is named."""
    from time import perf_counter

    from pyspark.sql import SparkSession

    from sparkloom.operators import similarity, sparse
    from sparkloom.sources import files

    params = parse(argv if argv is not None else __import__("sys").argv[1:])
    began = perf_counter()
    spark = SparkSession.builder.master(f"local[{params.nthreads}]").getOrCreate()
    matrix = sparse.compact_columns(files.read_csr(spark, params.infstem))
    found = similarity.neighbors(matrix, "jaccard", params.minsim, params.nnbrs)
    if params.outfile:
        files.write_neighbors(found, params.outfile)
    else:
        found.write.format("noop").mode("overwrite").save()
    print(f"wclock: {perf_counter() - began:.3f} s")


if __name__ == "__main__":
    main()
