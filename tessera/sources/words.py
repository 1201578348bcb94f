"""Words that completions offer whatever the index holds."""

# Keywords, preprocessor directives, specifiers by macro, metadata keys, and
# the types that well-known calls return.
KEYWORDS = ("auto", "break", "case", "catch", "class", "const", "constexpr", "continue", "do", "else", "enum", "explicit", "false", "final", "for", "if", "inline", "mutable", "namespace", "noexcept", "nullptr", "override", "private", "protected", "public", "return", "static", "struct", "switch", "template", "this", "true", "try", "typename", "using", "virtual", "void", "while")
DIRECTIVES = ("include", "pragma once", "define", "ifdef", "ifndef", "if", "elif", "else", "endif", "undef")
SPECIFIERS = {
    "UPROPERTY": ("EditAnywhere", "EditDefaultsOnly", "EditInstanceOnly", "VisibleAnywhere", "VisibleDefaultsOnly", "VisibleInstanceOnly", "BlueprintReadOnly", "BlueprintReadWrite", "BlueprintAssignable", "BlueprintCallable", "Config", "GlobalConfig", "Transient", "DuplicateTransient", "SaveGame", "Instanced", "Replicated", "ReplicatedUsing", "Category", "meta"),
    "UFUNCTION": ("BlueprintCallable", "BlueprintPure", "BlueprintImplementableEvent", "BlueprintNativeEvent", "BlueprintAuthorityOnly", "BlueprintCosmetic", "CallInEditor", "Client", "Server", "NetMulticast", "Reliable", "Unreliable", "WithValidation", "Exec", "Category", "meta"),
    "UCLASS": ("Blueprintable", "BlueprintType", "Abstract", "NotBlueprintable", "Config", "DefaultConfig", "EditInlineNew", "CollapseCategories", "HideCategories", "ShowCategories", "ClassGroup", "meta"),
    "USTRUCT": ("BlueprintType", "Atomic", "NoExport", "meta"),
    "UENUM": ("BlueprintType", "ScriptName", "meta"),
}
COMMON_KEYS = ("DisplayName", "ToolTip", "ShortToolTip", "DeprecatedFunction", "DeprecationMessage", "DevelopmentOnly", "ScriptName")
KEYS = {
    "UPROPERTY": ("AllowPrivateAccess", "ClampMin", "ClampMax", "UIMin", "UIMax", "Units", "EditCondition", "EditConditionHides", "BindWidget", "BindWidgetOptional", "ExposeOnSpawn", "MakeEditWidget", "MultiLine", "AllowedClasses", "DisallowedClasses"),
    "UFUNCTION": ("WorldContext", "CallableWithoutWorldContext", "DefaultToSelf", "HidePin", "AdvancedDisplay", "AutoCreateRefTerm", "DeterminesOutputType", "ExpandEnumAsExecs", "Latent", "LatentInfo", "CompactNodeTitle", "Keywords"),
    "UCLASS": ("BlueprintSpawnableComponent", "ChildCanTick", "ChildCannotTick", "ShowWorldContextPin", "DontUseGenericSpawnObject"),
    "USTRUCT": ("HasNativeMake", "HasNativeBreak"),
}
KNOWN_CALLS = {
    "GetWorld": "UWorld", "GetGameInstance": "UGameInstance", "GetOwner": "AActor", "GetController": "AController", "GetPawn": "APawn",
    "GetPlayerController": "APlayerController", "GetComponentByClass": "UActorComponent", "FindComponentByClass": "UActorComponent",
}


def macro_words(macro: str, in_meta: bool) -> list[str]:
    """What may stand in a macro's arguments, or in its metadata."""
    keys = [*COMMON_KEYS, *KEYS.get(macro, ())]
    return keys if in_meta or macro not in SPECIFIERS else list(SPECIFIERS[macro])
