"""DataFrame operators. Tables that stand for lists carry an explicit ``position``."""
