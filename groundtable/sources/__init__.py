"""Adapters that turn raw tables and files into pages, sections and chunks."""
