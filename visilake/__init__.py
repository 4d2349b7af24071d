"""Search-visibility analytics as Spark jobs over whole tables of sites and queries."""
