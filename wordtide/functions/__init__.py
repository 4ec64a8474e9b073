"""Column expressions and the few Python functions that columns can't express."""
