"""The engine's operators: functions from columns to columns or from tables to tables, without actions."""
