"""Projects: specification, dependency graph, compiler, recommendations, lint, recipes, worlds."""
