"""Plans: the supplied tables as domain tables, and queries over them."""
