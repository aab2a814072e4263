"""All registered queries."""

from . import advanced, base, core, flagship, more, scalars, streams  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
