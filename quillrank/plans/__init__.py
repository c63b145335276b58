"""Execution plans of selected items, and the router that ties the operators together."""
