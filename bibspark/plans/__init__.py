"""Search expressions compiled to Columns, search plans, and the registry of tools."""
