"""Tenants' settings: checks before they are stored, and their table."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stages import STAGES, Stage, promote, run_stages, violation

#: What a new tenant starts with.
RESERVED = ("service", "namespace", "cluster", "env", "severity", "region")
ALLOWED = (*RESERVED, "host")
DENIED = ("request_id", "user_id", "trace_id", "span_id", "pod_uid")


@dataclass(frozen=True)
class Tenant:
    tenant_id: str
    reserved: tuple[str, ...] = RESERVED
    allow: tuple[str, ...] = ALLOWED
    deny: tuple[str, ...] = DENIED
    searchable: tuple[str, ...] = ()
    ingest_mb: int = 50
    queries: int = 8
    max_labels: int = 12
    max_body: int = 262_144
    max_fields: int = 64
    max_value: int = 2048
    retention_days: int = 7
    protected: bool = False
    legal_hold: bool = False
    pipelines: dict[str, list[Stage]] = field(default_factory=dict)
    active: str = ""
    version: int = 1

    def __post_init__(self) -> None:
        if not self.tenant_id.strip():
            raise ValueError("a tenant needs an id")
        if min(self.ingest_mb, self.queries, self.max_labels, self.max_body, self.max_fields, self.max_value, self.retention_days) < 0:
            raise ValueError("limits can't be negative")
        if self.active and self.active not in self.pipelines:
            raise ValueError("the active pipeline isn't one of the tenant's")
        for stages in self.pipelines.values():
            for s in stages:
                if s.type not in STAGES or not s.name.strip():
                    raise ValueError(f"unknown or unnamed stage {s.type!r}")


def default_pipeline(ignore_json_errors: bool = True, logfmt: bool = True) -> list[Stage]:
    """What tenants without a pipeline have: JSON, logfmt, the field `timestamp` as time, the field `level` as severity."""
    ignore = {"ignore_error": "true"}
    steps = [Stage("json", "json", ignore if ignore_json_errors else {})]
    steps += [Stage("logfmt", "logfmt")] if logfmt else []
    return [*steps, Stage("timestamp", "timestamp", {"source": "timestamp", "format": "rfc3339", **ignore}), Stage("severity", "severity", {"source": "level", **ignore})]


def pipeline_of(tenant: Tenant, default: list[Stage] | None = None) -> list[Stage]:
    """The active pipeline, or the first, or the default one."""
    if tenant.pipelines:
        return tenant.pipelines[tenant.active or next(iter(tenant.pipelines))]
    return default_pipeline() if default is None else default


def ingested(events: DataFrame, tenants: list[Tenant], default: list[Stage] | None = None) -> DataFrame:
    """Events through their tenants' pipelines, promotion and limits: adds `dropped`, `failed`, `errors` and `broken`,
    the stage or rule that an event fails, `unknown_tenant`, or null.

    Tenants with the same settings share a branch, so there are as many as there are different settings."""
    groups: dict[str, list[Tenant]] = {}
    for t in tenants:
        own = (pipeline_of(t, default), t.reserved, t.allow, t.deny, t.max_labels, t.max_body, t.max_fields, t.max_value)
        groups.setdefault(repr(own), []).append(t)
    none = {"dropped": F.lit(False), "failed": F.lit("unknown_tenant"), "errors": F.array().cast("array<string>")}
    known = F.coalesce(F.col("tenant_id").isin([t.tenant_id for t in tenants]), F.lit(False))
    out = events.where(~known).withColumns(none).withColumn("broken", F.col("failed"))
    for own in groups.values():
        t = own[0]
        rows = run_stages(events.where(F.col("tenant_id").isin([x.tenant_id for x in own])), pipeline_of(t, default))
        rows = promote(rows, list(t.reserved), list(t.allow), list(t.deny))
        rule = violation(t.max_labels, t.max_body, t.max_fields, t.max_value)
        out = out.unionByName(rows.withColumn("broken", F.coalesce("failed", F.when(~F.col("dropped"), rule))))
    return out


def changed(tenant: Tenant, **new) -> Tenant:
    """The tenant with other settings, one version on. New searchable fields share one with the old, if there are any."""
    if "searchable" in new:
        fields = tuple(new["searchable"])
        if len(set(fields)) < len(fields) or not all(f.strip() for f in fields):
            raise ValueError("searchable fields must be named once each")
        if tenant.searchable and not set(fields) & set(tenant.searchable):
            raise ValueError("no searchable field is left of the old ones")
        new["searchable"] = fields
    return replace(tenant, version=tenant.version + 1, **new)


def table(spark: SparkSession, tenants: list[Tenant]) -> DataFrame:
    """The columns that events and segments are joined with."""
    names = ("tenant_id", "retention_days", "protected", "legal_hold", "ingest_mb", "max_labels", "max_body", "max_fields", "max_value")
    rows = [tuple(asdict(t)[n] for n in names) for t in sorted(tenants, key=lambda t: t.tenant_id)]
    return spark.createDataFrame(rows, "tenant_id string, retention_days int, protected boolean, legal_hold boolean, ingest_mb int, max_labels int, max_body int, max_fields int, max_value int")
