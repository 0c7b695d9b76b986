"""Sources: operational tables, nested JSON reference data, the driver fixture."""

from sitewatt.sources.tables import load_tables, read_table, read_jdbc
from sitewatt.sources.fixture import Fixture, load_fixture
from sitewatt.sources.reference_json import load_reference_json

__all__ = ["load_tables", "read_table", "read_jdbc", "Fixture", "load_fixture", "load_reference_json"]
