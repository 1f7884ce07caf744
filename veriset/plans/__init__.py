"""Query plans over the driver tables, and the scratch tables that cut lineage."""
