"""Reading and writing: CSV and Parquet by Spark, the statistical formats by parsers of this package."""

from quadrat.sources.files import (  # noqa: F401
    create_from_csv,
    create_from_parquet,
    create_from_sas,
    create_from_spss,
    create_from_stata,
    read_csv,
    read_parquet,
    read_sas,
    read_sas_with_labels,
    read_spss,
    read_spss_with_labels,
    read_stata,
    read_stata_with_labels,
    scan_csv,
    scan_parquet,
    write_csv,
    write_parquet,
    write_sas,
    write_spss,
    write_stata,
)
