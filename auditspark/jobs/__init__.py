"""The registered queries, by module; each module has QUERIES and ORACLE."""

from auditspark.jobs import changes, code_audit, flows, outside, relational, repo_files, reporting, scanner_hooks, scans, services, source_text, weighing, whole_findings

MODULES = [relational, source_text, code_audit, changes, flows, reporting, outside, repo_files, scans, services, scanner_hooks, whole_findings, weighing]
