"""Citation retrieval and ranking analytics as composable DataFrame transformations."""
