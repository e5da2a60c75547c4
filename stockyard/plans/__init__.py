"""Named queries over a folder of tables: thin plans that apply the operators, each beside its SQL."""
