"""Vocabularies and schemas of the index tables."""

SYMBOL_KINDS = ("type", "interface", "enum", "method", "constructor", "property", "field", "enum_member", "delegate")
TYPE_LIKE = ("type", "interface", "enum", "delegate")
EDGE_TYPES = ("imports", "inherits", "implements", "injects", "calls", "string_ref", "mvvm_view", "mvvm_primary_service")
CONFIDENCES = ("exact", "heuristic", "unresolved")
PROJECT_EDGE_KINDS = ("project_reference", "package_reference")

SYMBOLS = "id long, file_id long, kind string, name string, qualified_name string, span_start_line int, span_end_line int, span_start_col int, span_end_col int"
EDGES = "id long, src_symbol_id long, dst_symbol_id long, src_file_id long, dst_file_id long, edge_type string, confidence string, ref_start_line int, ref_start_col int, ref_end_line int, ref_end_col int, meta_json string"
FILES = "id long, path string, folder_id long, size long, mtime_ns long, sha256 string, language string, last_indexed_at string, content string"
PROJECTS = "id long, name string, path string, kind string, domain string"
PROJECT_FILES = "project_id long, file_id long"
PROJECT_EDGES = "id long, src_project_id long, dst_project_id long, edge_kind string, target string"
FEATURES = "id long, name string, domain string, viewmodel string, service string, project string"
FOLDERS = "id long, path string, parent_id long"
META = "key string, value string"
TABLES = {"symbols": SYMBOLS, "edges": EDGES, "files": FILES, "projects": PROJECTS, "project_files": PROJECT_FILES, "project_edges": PROJECT_EDGES, "features": FEATURES, "folders": FOLDERS, "meta": META}
