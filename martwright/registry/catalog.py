"""All registered queries, in the order of the operator inventory."""

from martwright.registry import Catalog, dashboard, loads, quality, silver, star, telemetry

CATALOG = Catalog()
for section in (loads, silver, star, dashboard, quality, telemetry):
    CATALOG.update(section.QUERIES)
