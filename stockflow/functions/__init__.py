"""Column functions: calendar keys, typing rules and value rules."""
