"""New variant files judged as they arrive.

Judging a site is stateless, so the batch
operators serve a stream of sites without change.  Blocks are a stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.concordance import block_join


def place_sites(sites: DataFrame, blocks: DataFrame) -> DataFrame:
    """Streamed sites (chrom, pos0, ...) with all blocks that hold them: the batch join, on a stream and a stored table."""
    return block_join(sites, blocks, first_only=False)
