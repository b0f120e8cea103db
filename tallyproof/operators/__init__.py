"""DataFrame operators: tables, retrieval, evidence, formulas, geometry."""
