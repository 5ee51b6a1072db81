"""Whole jobs put together from sources and operators, and the queries over relational tables that show each operator."""
