"""Session, lineage and broadcast helpers shared by the operators."""
