"""Part of the report-estate engine."""
