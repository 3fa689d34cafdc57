"""Column-level building blocks: seeded draws, value providers, text and distributions."""
