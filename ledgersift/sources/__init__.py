from .files import load, read_csv_files, scan_csv, sniff_csv_dialects, write_results
from .records import scan_dbf, scan_xlsx

__all__ = ["load", "scan_csv", "read_csv_files", "sniff_csv_dialects", "write_results", "scan_dbf", "scan_xlsx"]
