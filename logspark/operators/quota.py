"""Rate limits as a pass over each tenant's requests in order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEBIBYTE = 1 << 20


def admit(requests: DataFrame, default_mb: int = 50) -> DataFrame:
    """requests (request_id, tenant_id, at_ns, bytes, limit_mb) -> request_id, tenant_id, admitted, retry_after_ms.

    A tenant's bucket holds twice what its limit lets in a second, starts full, and fills with the time between
    requests. A request that finds too little waits for the rest, a millisecond at least. A limit of 0 or less is one
    MiB a second, none is the default. What is in the bucket depends on every earlier decision, so a tenant is read in
    order, batch by batch; a task remembers two numbers."""
    limit = F.coalesce("limit_mb", F.lit(default_mb))
    rate = (F.when(limit > 0, limit).otherwise(1) * MEBIBYTE).cast("double")
    rows = requests.select("request_id", "tenant_id", "at_ns", "bytes", rate.alias("rate"))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, level, last = None, 0.0, 0
        for b in batches:
            admitted, wait = [], []
            for own, at, size, rate in zip(b["tenant_id"], b["at_ns"], b["bytes"], b["rate"]):
                if own != tenant:
                    tenant, level, last = own, 2 * rate, at
                level, last = min(2 * rate, level + (at - last) * rate / 1e9), at
                ok = level >= size
                admitted.append(ok)
                wait.append(0 if ok else max(1, int(-(-(size - level) * 1000 // rate))))
                level -= size if ok else 0
            yield b[["request_id", "tenant_id"]].assign(admitted=admitted, retry_after_ms=wait)

    dealt = rows.repartition("tenant_id").sortWithinPartitions("tenant_id", "at_ns", "request_id")
    return dealt.mapInPandas(decide, "request_id long, tenant_id string, admitted boolean, retry_after_ms long")
