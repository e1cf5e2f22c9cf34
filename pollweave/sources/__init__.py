"""Typed readers of tables and landing-zone JSON, keyed state tables and sinks."""
