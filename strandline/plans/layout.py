"""Sizes that decide how ordered work is cut into Spark partitions."""

from __future__ import annotations

import math
from dataclasses import dataclass

ROW = "row_idx"
BLOCK = "_block"
BUCKET = "_bucket"


@dataclass(frozen=True)
class Layout:
    """Cut sizes.

    rows_per_bucket  target rows of one value range (a sort task)
    max_buckets      most value ranges; also the most rows of any offset table that is broadcast
    min_block        smallest number of neighbouring rows one window task group holds
    max_blocks       most row blocks of one table; also bounds the broadcast block offsets
    direct_rows      groups known to be no larger than this are ranked without value ranges
    """

    rows_per_bucket: int = 1 << 17
    max_buckets: int = 1 << 14
    min_block: int = 1 << 13
    max_blocks: int = 1 << 16
    samples_per_bucket: int = 20
    direct_rows: int = 1 << 20

    def buckets_for(self, n_rows: int) -> int:
        return max(1, min(self.max_buckets, math.ceil(n_rows / self.rows_per_bucket)))

    def block_for(self, n_rows: int) -> int:
        return max(self.min_block, math.ceil(n_rows / self.max_blocks))


DEFAULT = Layout()
