from cartlytics.sources.schemas import SCHEMAS, check_schema, schema_report  # noqa: F401
from cartlytics.sources.csv_files import load_csv_table, read_csv_table  # noqa: F401
from cartlytics.sources.readers import read_table  # noqa: F401
