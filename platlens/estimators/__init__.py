"""Position estimators: driver loops whose every step is one distributed pass over packed documents."""
