"""Action plans as tables; nothing is executed."""
