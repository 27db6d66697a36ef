"""Short entry points that group the operators by task."""

from tallybook.operators.filters import rules_by_flag, search_rules
from tallybook.operators.rule_changes import apply_rule_changes
from tallybook.operators.rules import rule_counts, rule_overlaps, rule_terms
from tallybook.plans.dashboard import dashboard_bundle
from tallybook.plans.drift import validation_bundle
from tallybook.plans.load import load_checks, load_from_statements, load_ledger
from tallybook.plans.reports import budget_table, describe_series, expense_report, report_bundle
from tallybook.sources.rule_store import scan_rules
from tallybook.sources.tables import as_json_records, scan_ledger, scan_ledger_csv, sink_csv, sink_parquet
from tallybook.streaming.ingest import ingest, ingest_statements


class Ledger:
    load = staticmethod(load_ledger)
    load_statements = staticmethod(load_from_statements)
    checks = staticmethod(load_checks)
    scan = staticmethod(scan_ledger)
    scan_csv = staticmethod(scan_ledger_csv)
    save = staticmethod(sink_parquet)
    save_csv = staticmethod(sink_csv)
    records = staticmethod(as_json_records)
    ingest = staticmethod(ingest)
    ingest_statements = staticmethod(ingest_statements)


class Report:
    describe = staticmethod(describe_series)
    budget = staticmethod(budget_table)
    expense = staticmethod(expense_report)
    report = staticmethod(report_bundle)
    dashboard = staticmethod(dashboard_bundle)
    validate = staticmethod(validation_bundle)


class Rules:
    scan = staticmethod(scan_rules)
    search = staticmethod(search_rules)
    by_flag = staticmethod(rules_by_flag)
    terms = staticmethod(rule_terms)
    overlaps = staticmethod(rule_overlaps)
    counts = staticmethod(rule_counts)
    apply = staticmethod(apply_rule_changes)
