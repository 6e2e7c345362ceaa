"""lakescan: scan, filter, project, aggregate and join columnar data on Spark."""

from lakescan.array import Array, ArrayBuilder, from_bool_list, from_f32_list, from_f64_list, from_i32_list, from_i64_list, from_str_list, import_array
from lakescan.frame import Batch, empty, from_arrow, from_batch
from lakescan.functions import call, case, cast, col, lit
from lakescan.plans import QueryPlan
from lakescan.scan import ScanResult, scan, scan_csv, scan_ipc, scan_json, scan_parquet
from lakescan.schema import Schema
from lakescan.session import EngineConfig, get_spark
from lakescan.sinks import append_ipc_file, write, write_ipc_batches, write_ipc_file, write_ipc_folder

__version__ = "0.1.0"


def version() -> str:
    return __version__


__all__ = [
    "Array", "ArrayBuilder", "Batch", "EngineConfig", "QueryPlan", "ScanResult", "Schema",
    "append_ipc_file", "call", "case", "cast", "col", "empty", "from_arrow", "from_batch", "from_bool_list", "from_f32_list", "from_f64_list",
    "from_i32_list", "from_i64_list", "from_str_list", "get_spark", "import_array", "lit", "scan", "scan_csv", "scan_ipc", "scan_json",
    "scan_parquet", "version", "write", "write_ipc_batches", "write_ipc_file", "write_ipc_folder",
]
