"""Column-level building blocks: text preparation and vector / map arithmetic."""
