"""Sources, sinks and the adapters from raw tables to the engine's tables."""
