"""DataFrame operators over run events and heads."""
