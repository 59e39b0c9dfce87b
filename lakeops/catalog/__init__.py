"""All registered queries and their check SQL."""

from lakeops.catalog import registry
from lakeops.catalog import basics, ledgers, series, storage, telecom, trust  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    return dict(registry.ORACLES)
