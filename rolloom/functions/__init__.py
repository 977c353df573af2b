"""Column functions and the few Python functions that built-in expressions can't express."""
