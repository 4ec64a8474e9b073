"""Writers of tier, phrase and state tables."""
