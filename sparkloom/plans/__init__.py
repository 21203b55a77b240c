"""Declared models, parameters, macros, graphs, loads, refresh runs, offline tests and table comparison."""
